"""Hand-computed goldens, properties, round trips of files and the streaming windows."""

import json
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ontospark.functions import prompts as P
from ontospark.functions import vector as V
from ontospark.operators import classifiers as C
from ontospark.operators import experiments as X
from ontospark.operators import graph as G
from ontospark.operators import metrics as M
from ontospark.operators import models as L
from ontospark.operators import relations as R
from ontospark.operators import similarity as S
from ontospark.operators import weights as W
from ontospark.operators import workflows as flows
from ontospark.operators.order import numbered
from ontospark.plans import registry
from ontospark.sources import files
from ontospark.streaming import windows

SF = "/root/testdata/sf0.001"


def test_binary_metrics_golden(spark):
    df = spark.createDataFrame([(0.8, 1), (0.2, 0), (0.9, 1), (0.1, 0)], "score double, y int")
    got = {round(r.threshold, 2): (r.accuracy, round(r.precision, 4), r.recall, round(r.f1, 4)) for r in M.sweep(df, [0.05, 0.1, 0.15, 0.5, 0.9]).collect()}
    assert got == {0.05: (0.5, 0.5, 1, 0.6667), 0.1: (0.75, 0.6667, 1, 0.8), 0.15: (0.75, 0.6667, 1, 0.8), 0.5: (1, 1, 1, 1), 0.9: (0.5, 0, 0, 0)}
    assert M.roc_auc(df).first().auc == 1.0
    assert round(M.weighted_bce(df).first().loss, 6) == 0.164252
    s = M.score_stats(df).first()
    assert s.mean == 0.5 and round(s.std, 6) == 0.353553


def test_metrics_edges(spark):
    none = spark.createDataFrame([], "score double, y int")
    assert M.roc_auc(none).first().auc == 0.0
    assert [r.f1 for r in M.sweep(none, [0.5]).collect()] == [0.0]
    one = spark.createDataFrame([(0.3, 1), (0.3, 1), (None, 0), (0.1, None)], "score double, y int")
    assert M.roc_auc(one).first().auc == 0.0
    ties = spark.createDataFrame([(0.5, 1), (0.5, 0)], "score double, y int")
    assert M.roc_auc(ties).first().auc == 0.5
    sets = spark.createDataFrame([(["a", "b"], ["a"]), (["c"], ["c"]), ([], None), (["d"], ["e"])], "t array<string>, g array<string>")
    r = M.set_metrics(sets, "t", "g").first()
    assert (r.jaccard, round(r.f1, 6), r.exact) == (0.625, 0.666667, 0.5)


def test_attention_goldens(spark):
    rows = [(0, [1.0, 0.0, 0.0, 1.0]), (1, [0.0, 1.0, 1.0, 0.0]), (2, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    whole = {(r.i, r.j): round(r.score, 6) for r in S.attention(df, "id", "v", 2, 100).collect()}
    assert [whole[0, j] for j in range(3)] == [0.525216, 0.127689, 0.347095] and whole[2, 2] == 0.430715
    two = {(r.i, r.j): round(r.score, 6) for r in S.attention(df, "id", "v", 2, 2).collect()}
    assert [two[0, j] for j in range(3)] == [0.804429, 0.195571, 1.0]


def test_graph_goldens(spark):
    e = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 0.1), ("c", "d", 1.0)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    assert {r.node: r.degree for r in G.degrees(e, nodes).collect()} == {"a": 2, "b": 2, "c": 3, "d": 1}
    assert {r.node: round(r.coefficient, 6) for r in G.clustering(e).collect()} == {"a": 1, "b": 1, "c": 0.333333, "d": 0}
    rank = {r.node: r["rank"] for r in G.pagerank(e, nodes, rounds=40).collect()}
    assert {k: round(v, 4) for k, v in rank.items()} == {"a": 0.3426, "b": 0.2425, "c": 0.2687, "d": 0.1463}
    h = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b")], "child string, parent string")
    got = {r.node: r.role for r in G.roles(h, spark.createDataFrame([(x,) for x in "abcde"], "node string")).collect()}
    assert got == {"a": "root", "b": "intermediate", "c": "leaf", "d": "leaf", "e": "isolated"}
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("x", "x")], "child string, parent string")
    assert {tuple(r.cycle) for r in G.short_cycles(loop).collect()} == {("a", "b"), ("a", "b", "c"), ("x",)}


def test_pagerank_runs_to_its_tolerance(spark):
    """The ranks of FIXTURES 3.3, then the very iterate at which networkx's rule (sum of moves < n * tol) stops, on a slow chain."""
    e = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 0.1), ("c", "d", 1.0)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    rank = {r.node: round(r["rank"], 6) for r in G.pagerank(e, nodes, tol=1e-8).collect()}
    assert rank == {"a": 0.34256, "b": 0.242493, "c": 0.268691, "d": 0.146256}
    w = np.zeros((7, 7))
    for i in range(5):  # node 6 has no edge
        w[i, i + 1] = w[i + 1, i] = 1.0 + 4 * (i % 2)
    x, last, turns = np.full(7, 1 / 7), np.zeros(7), 0
    share = w / np.where(w.sum(1, keepdims=True) > 0, w.sum(1, keepdims=True), 1)
    while np.abs(x - last).sum() >= 7e-6:
        last, turns = x, turns + 1
        x = 0.85 * (x @ share + x[6] / 7) + 0.15 / 7
    chain = spark.createDataFrame([(i, i + 1, float(w[i, i + 1])) for i in range(5)], "src long, dst long, weight double")
    all7 = spark.createDataFrame([(i,) for i in range(7)], "node long")
    got = {r.node: r["rank"] for r in G.pagerank(chain, all7).collect()}
    assert turns > 20 and max(abs(got[i] - x[i]) for i in range(7)) < 1e-12
    with pytest.raises(RuntimeError, match="still move"):
        G.pagerank(chain, all7, most=5)


def test_long_loops_are_listed(spark):
    """Loops of 1, 2, 5 and 40 nodes with tails below them, and a tree."""
    def ring(name, n):
        return [(f"{name}{(i * 7) % n:02}", f"{name}{(i + 1) * 7 % n:02}") for i in range(n)]

    rows = [("x", "x"), *ring("b", 2), *ring("e", 5), *ring("z", 40), ("low", "e03"), ("lower", "low"), ("t1", "t0"), ("t2", "t1")]
    got = {tuple(r.cycle) for r in G.all_cycles(spark.createDataFrame(rows, "child string, parent string")).collect()}
    assert got == {("x",), ("b00", "b01"), tuple(f"e{i * 7 % 5:02}" for i in range(5)), tuple(f"z{i * 7 % 40:02}" for i in range(40))}
    assert G.all_cycles(spark.createDataFrame(rows[-2:], "child string, parent string")).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([('x {"a":1, "types": ["q","p"]} y',), ("none",), ('{"types": broken}',), (None,)], "t string")
    assert [r[0] for r in df.select(P.extract_types(F.col("t"))).collect()] == [["p", "q"], [], [], []]
    one = spark.createDataFrame([(["a", "it's"],)], "x array<string>")
    assert one.select(P.python_list(F.col("x"))).first()[0] == "['a', \"it's\"]"
    assert one.select(P.step_of(F.lit("a/metrics_step_12.json")), P.step_of(F.lit("x")), P.split_of(F.lit("test/a/Train/b")), P.known_part(F.lit("a/OBI/b"), ["OBI", "PO"])).first()[:] == (12, 0, "train", "OBI")


def test_prompts_and_names(spark):
    row = spark.createDataFrame([([("iron", ["metal", "it's"])], "ore", ["a", 'b "c"'], "why")], "e array<struct<term:string,types:array<string>>>, term string, types array<string>, why string")
    user = row.select(P.few_shot(F.col("e"), F.col("term"))).first()[0]
    assert user == f"\n\nCLASSIFICATION EXAMPLES:\n1. Term: 'iron' → Types: ['metal', \"it's\"]\n\nEND OF EXAMPLES.\n\nTERM: ore\n\nTASK: {P.TASK}"
    assert row.select(P.few_shot(F.lit(None).cast("array<struct<term:string,types:array<string>>>"), F.col("term"))).first()[0] == f"\nTERM: ore\n\nTASK: {P.TASK}"
    assert json.loads(row.select(P.answer_json(F.col("why"), F.col("types"))).first()[0]) == {"reasoning": "why", "types": ["a", 'b "c"']}
    names = ["20250711_191806_DOID_ep10_lr1e-04_bs32_eval100_seed42_freeze_lora_r8_a16", "20250715_PO_ep5", "MatOnto_ep1_lr2e-05_bs8_ds_weighted_pos0.5_qwen3_max70", "", None]
    got = [r.r for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(P.parse_run(F.col("n")).alias("r")).collect()]
    assert (got[0].dataset, got[0].epochs, got[0].lr, got[0].batch, got[0].seed, got[0].freeze, got[0].rank, got[0].alpha, str(got[0].at)) == ("DOID", 10, 1e-4, 32, 42, "lora", 8, 16, "2025-07-11 19:18:06")
    assert (got[1].dataset, got[1].epochs, got[1].lr, got[1].sampling_strategy) == ("PO", 5, None, "balanced")
    assert (got[2].dataset, got[2].dataset_strategy, got[2].positive_ratio, got[2].qwen3, got[2].max_steps) == ("MatOnto", "weighted", 0.5, True, 70)
    assert got[3].dataset is None


def test_models(spark):
    t = spark.createDataFrame([("1", "iron ore stone", ["ore"]), ("2", None, None), ("3", "abc", None)], "id string, term string, types array<string>")
    v = {r.id: r.v for r in t.select("id", L.encode(F.col("term"), L.LetterEncoder).alias("v")).collect()}
    assert v["2"] is None and abs(sum(x * x for x in v["1"]) - 1) < 1e-9 and np.allclose(v["3"][:4], [3**-0.5] * 3 + [0.0])
    a = {r.id: r.a for r in t.select("id", L.generate(F.col("term"), L.WordGenerator).alias("a")).collect()}
    assert (a["1"].types, a["1"].attempts, a["1"].ok) == (["iron", "stone"], 1, True) and (a["2"].types, a["2"].attempts, a["2"].ok) == ([], 0, False) and a["3"].types == []

    def broken():
        def answer(asked):
            if len(asked) > 1 or "abc" in asked[0]:
                raise ValueError("too much")
            return ['{"types": ["x", 3]}']
        return answer

    b = {r.id: r.a for r in t.select("id", L.generate(F.col("term"), broken, fallback=L.WordGenerator, retries=2).alias("a")).collect()}
    assert (b["1"].types, b["1"].attempts, b["1"].ok) == (["iron", "stone"], 2, False) and (b["3"].types, b["3"].ok) == ([], False)
    p = L.predict_types(t, L.WordGenerator)
    assert p.count() == 3 and L.typing_metrics(t, p).first().n == 1 and L.typing_metrics(t.filter("id <> '1'"), p).count() == 0
    with pytest.raises(Exception, match="without an id"):
        L.predict_types(t.withColumn("id", F.lit(None).cast("string")), L.WordGenerator).collect()
    s = spark.createDataFrame([(0, 1, 0.9), (1, 0, 0.5), (1, 1, 0.99), (2, 0, 0.7)], "i long, j long, score double")
    assert {(r.child_id, r.parent_id) for r in L.extract_relationships(s, 0.5).collect()} == {(0, 1), (2, 0)}
    assert [r.child_id for r in L.extract_relationships(s, 0.1, 0.7, 1).collect()] == [0] and L.extract_relationships(s, 0.1, loops=None).count() == 4
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "id long, text string")
    assert {(r.child_id, r.parent_id) for r in L.extract_relationships(s, 0.1, loops="text", names=names).collect()} == {(0, 1), (1, 0)}
    r = L.threshold_rerun(s, 0.6, 0.8).first()
    assert (r.total, r.old_pairs, r.new_pairs, r.difference) == (3, 2, 1, -1) and L.confidence_stats(L.extract_relationships(s.limit(0), 0.1)).first().n == 0
    h = L.predict_hierarchy(names, L.LetterEncoder, threshold=0.1)
    assert {r.child for r in h.collect()} == {"a", "b"}


def test_classifiers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(3) + 4 * np.eye(3)[i % 3]).tolist(), [f"l{i % 3}", "all"] + (["odd"] if i % 2 else [])) for i in range(90)] + [(900, None, ["l0"]), (901, [0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "id long, x array<double>, labels array<string>")
    for kind in ("forest", "logistic"):
        model = C.OneVsRest(kind, trees=10, depth=4).fit(df.filter("id % 5 <> 0"))
        p = model.probabilities(df.filter("id % 5 = 0 and id < 900"), "id").collect()
        assert len(p) == 18 * len(model.models)
        assert np.mean([(r.p > 0.5) == (int(r.label[1]) == r.id % 3) for r in p if r.label[0] == "l"]) > 0.9
    assert C.OneVsRest().fit(df.limit(0)).probabilities(df, "id").count() == 0
    y = {r.row: r.y for r in C.indicators(spark.createDataFrame([(1, ["b", "a"]), (2, None), (3, ["b", None])], "row int, t array<string>"), "row", "t").collect()}
    assert y == {1: [1, 1], 2: [0, 0], 3: [0, 1]}


def test_weights(spark, tmp_path):
    w = spark.createDataFrame([("q", 0, [1.0, 2.0]), ("q", 1, [3.0, 4.0]), ("k", 0, [5.0, 6.0])], "name string, row int, values array<double>")
    down, up = spark.createDataFrame([("q", 0, [1.0, 10.0])], w.schema), spark.createDataFrame([("q", 0, [2.0]), ("q", 1, [3.0])], w.schema)
    got = {(r.name, r.row): r["values"] for r in W.lora_merge(w, down, up, 4, 1).collect()}
    assert got == {("q", 0): [9.0, 82.0], ("q", 1): [15.0, 124.0], ("k", 0): [5.0, 6.0]}
    assert W.parameter_count(w, spark.createDataFrame([("k",)], "name string")).first()[:] == (6, 2, 24) and W.parameter_count(w.limit(0)).first()[:] == (0, 0, 0)
    W.save_model(w, str(tmp_path / "m"), {"heads": 2})
    back, config = W.load_model(spark, str(tmp_path / "m"))
    assert config == {"heads": 2} and back.count() == 3
    best = tmp_path / "run/best_models"
    best.mkdir(parents=True)
    (best / "best_models.json").write_text(json.dumps({"best_models": [{"roc_auc": 0.9, "step": 5, "model_path": "/gone", "model_filename": "m5"}]}))
    with pytest.raises(FileNotFoundError):
        W.best_checkpoint(spark, str(tmp_path / "run"))
    (best / "m5").write_text("x")
    assert W.best_checkpoint(spark, str(tmp_path / "run"))["threshold"] == 0.5
    (tmp_path / "run/best_results.json").write_text(json.dumps({"best_results": {"best_thresholds": {"f1_score": {"threshold": 0.3}}}}))
    assert W.best_checkpoint(spark, str(tmp_path / "run"))["threshold"] == 0.3
    (best / "best_model_evaluation_summary.json").write_text(json.dumps({"best_thresholds": {"f1": 0.2}}))
    found = W.best_checkpoint(spark, str(tmp_path / "run"))
    assert found["threshold"] == 0.2 and found["model"].endswith("m5")


def test_pair_figures_match_numpy(spark):
    """Counts inside blocks against a whole matrix: nulls, odd lengths, a repeated id, few positives."""
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((300, 5)) / 4, [f"l{i % 7}" for i in range(300)]
    rows = [(i if i else 299, v.tolist(), c) for i, (v, c) in enumerate(zip(x, y))] + [(500, None, "l1"), (501, [1.0], "l1"), (502, [float("nan")] * 5, "l1"), (None, [1.0] * 5, "l1"), (503, [1.0, None, 1.0, 1.0, 1.0], "l1")]
    df = spark.createDataFrame(rows, "id long, v array<double>, y string")
    ids = np.array([r[0] for r in rows[:300]])
    s, off = x @ x.T, ids[:, None] != ids[None, :]
    same = np.array(y)[:, None] == np.array(y)[None, :]
    p = S.PairScores(df, "id", "v", "y", block=64)
    st = p.stats().first()
    assert st.n == off.sum() and np.allclose([st.low, st.high, st.mean, st.std], [s[off].min(), s[off].max(), s[off].mean(), s[off].std()])
    cuts = [-0.1, 0.0, 0.2]
    m = {r.threshold: (r.tp, r.fp, r.tn, r.fn) for r in M.sweep_counts(p.passed(cuts), cuts).collect()}
    assert m == {c: ((off & same & (s > c)).sum(), (off & ~same & (s > c)).sum(), (off & ~same & (s <= c)).sum(), (off & same & (s <= c)).sum()) for c in cuts}
    exact = M.roc_auc(spark.createDataFrame(list(zip(s[off].tolist(), same[off].astype(int).tolist())), "score double, y int")).first()
    near = S.pair_auc(p).first()
    assert abs(near.auc - exact.auc) < 1e-6 and (near.pos, near.neg) == (exact.pos, exact.neg)
    for share in (0.0, 0.37, 0.999, 1.0):
        assert abs(S.PairScores(df, "id", "v", diagonal=True, block=64).percentile(share) - np.percentile(s, 100 * share)) < 1e-12
    few = S.PairScores(df, "id", "v", diagonal=True, block=64)
    saved, S.FEW = S.FEW, 50
    try:
        assert abs(few.percentile(0.5, bins=16) - np.percentile(s, 50)) < 1e-12
    finally:
        S.FEW = saved
    assert {r.i: r.n for r in p.above(0.2).collect()} == {int(i): int(n) for i, n in ((i, (off & (s > 0.2))[ids == i].sum()) for i in set(ids.tolist())) if n}
    top = [(r.i, r.j) for r in S.highest_pairs(spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, -1.0])], "id long, v array<double>"), "id", "v", 20).collect()]
    assert top == [(1, 3), (2, 3), (1, 2)]
    none = S.PairScores(df.limit(0), "id", "v", "y")
    assert none.stats().first().n == 0 and none.percentile(0.5) is None and none.histogram().count() == 0 and S.pair_auc(none).first().auc == 0.0


def test_positions(spark):
    rows = [(v,) for v in ["b", None, "é", "a", "b", "zz", ""]]
    got = numbered(spark.createDataFrame(rows, "t string"), "t").collect()
    assert [r.t for r in sorted(got, key=lambda r: r.pos)] == [None, "", "a", "b", "b", "zz", "é"]
    assert sorted((r.id, r.pos) for r in numbered(spark.range(5000).select((F.col("id") * 3).alias("id")), "id").collect()) == [(3 * i, i) for i in range(5000)]
    assert numbered(spark.range(0), "id").count() == 0


def test_structure(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b")], "child string, parent string")
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    r = G.structure_report(links, nodes).first()
    assert (r.root, r.leaf, r.intermediate, r.isolated, r.components, r.largest, r.max_depth, r.density) == (1, 2, 1, 1, 2, 4, 2, 0.15)
    assert G.max_depth(links, compat=True).first()[0] == 0 == G.max_depth(links.limit(0)).first()[0]


def test_workflows(spark, tmp_path):
    terms = spark.createDataFrame([(i, t) for i, t in enumerate(["iron", "iron ore", "salt", "rock salt", None])], "id long, text string")
    path, out = str(tmp_path / "run"), str(tmp_path / "cut")
    got = flows.run_inference(terms, L.LetterEncoder, path, threshold=0.3, dataset="x")
    assert got.keys() == {"terms", "scores", "pairs", "metadata"} and got["scores"].count() == 16 and got["terms"].count() == 4
    meta = got["metadata"].first()
    assert (meta.n_terms, meta.n_pairs, meta.threshold_used) == (4, got["pairs"].count(), 0.3) and json.loads(meta.model_info) == {"dataset": "x"}
    assert flows.run_inference(terms.limit(0), L.LetterEncoder, path)["terms"].count() == 4  # what is there is read
    cut = flows.cut_anew(spark, path, 0.1, out)
    row = cut["metadata"].first()
    assert cut["pairs"].count() == row.new_pairs == row.n_pairs == got["pairs"].count() + cut["changes"].count() and row.scores_at == f"{path}/scores"
    with pytest.raises(ValueError):
        flows.cut_anew(spark, path, -0.1, out)
    assert "structure" in flows.report(spark, out.replace("cut", "run"), "run") and flows.analyze_results(spark, path)["structure"].first().terms == 4


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, []), (4, None)], "id long, v array<double>")
    assert [r[0] for r in df.orderBy("id").select(V.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], None, None, None]
    tok = spark.createDataFrame([(1, 0, [1.0, 1.0], True), (1, 1, [3.0, 5.0], True), (1, 2, [9.0, 9.0], False)], "id long, pos int, vec array<double>, mask boolean")
    assert [V.pool_tokens(tok, "id", h).first().vec for h in ("first", "last", "mean")] == [[1, 1], [3, 5], [2, 3]]
    assert df.filter("id = 1").select(V.linear(F.col("v"), F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))))).first()[0] == [3.0, 7.0]


def test_top_k_blocks_agree(spark):
    x = np.random.default_rng(1).standard_normal((90, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    want = {(i, int(j)) for i in range(90) for j in np.argsort(-np.where(np.arange(90) == i, -9e9, x[i] @ x.T), kind="stable")[:4]}
    for block in (16, 1000):
        assert {(r.i, r.j) for r in S.top_k(df, df, "id", "v", 4, block=block).collect()} == want


def test_splits_and_samples(spark):
    df = spark.createDataFrame([(i, "big" if i % 3 else "small") for i in range(100)] + [(1000, None), (1001, "alone")], "id long, g string")
    got = R.split_groups(df, "id", "g").collect()
    assert len(got) == 102 and sum(r.side == "test" for r in got if r.grp == "big") == 14 and {r.side for r in got if r.grp in (None, "alone")} == {"train"}
    w = df.withColumn("w", F.when(F.col("id") < 50, 1.0).otherwise(0.0))
    assert R.sample_weighted(w, "id", "w", 200).count() == 50
    pairs = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 13)], "parent_id long, child_id long")
    entities = spark.createDataFrame([("g", i) for i in (1, 2, 3, 10, 11, 12, 13, 14, None, 14)] + [("h", 20), ("h", 21)], "grp string, id long")
    b = R.balanced_batch(entities, pairs, 4).collect()
    assert {(r.grp, r.side, r.pos) for r in b} == {("g", side, i) for side in ("child", "parent") for i in range(4)} | {("h", side, i) for side in ("child", "parent") for i in range(2)}
    kids, chosen = ({r.id for r in b if (r.grp, r.side) == ("g", side)} for side in ("child", "parent"))
    assert {p for p, c in [(1, 10), (1, 11), (2, 12), (3, 13)] if c in kids} <= chosen and len(chosen) == 4
    grouped = pairs.withColumn("grp", F.lit("g"))
    few = R.related_batch(grouped, 6).collect()
    assert sorted((r.side, r.pos) for r in few) == [(side, i) for side in ("child", "parent") for i in range(6)]
    assert {r.id for r in few if r.side == "parent"} <= {1, 2, 3} and {r.id for r in few if r.side == "child"} <= {10, 11, 12, 13}
    assert R.balanced_batch(entities.limit(0), pairs, 4).count() == R.related_batch(grouped.limit(0), 4).count() == 0
    sample = R.off_diagonal_sample(3, spark.range(200).select(F.col("id").alias("draw"))).collect()
    assert {(r.i, r.j) for r in sample} == {(i, j) for i in range(3) for j in range(3) if i != j} and R.off_diagonal_sample(1, spark.range(5).select(F.col("id").alias("draw"))).count() == 0
    m = R.relation_matrix(spark.createDataFrame([(10,), (12,)], "id long"), spark.createDataFrame([(1,), (2,)], "id long"), pairs)
    assert {(r.child_id, r.parent_id): r.y for r in m.collect()} == {(10, 1): 1, (10, 2): 0, (12, 1): 0, (12, 2): 1}


def test_log_operators(spark):
    log = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate([3, 1, 4, 1, 5, 9])], "run string, step long, value double")
    assert [r.step for r in X.running_best(log, "run", "step", "value").orderBy("step").collect()] == [0, 2, 4, 5]
    assert [r.step for r in X.keep_top(log, "run", "value", "step").orderBy("step").collect()] == [4, 5]
    assert X.moving_average(log, "run", "step", "value", 5).count() == 2 and X.moving_average(log, "run", "step", "value").count() == 0
    longer = spark.createDataFrame([("r", i, float(i)) for i in range(12)], "run string, step long, value double")
    assert [r.average for r in X.moving_average(longer, "run", "step", "value").orderBy("step").collect()] == [float(i) for i in range(2, 10)]
    both = X.merged_summaries(spark.createDataFrame([(1, None, 5)], "k int, a int, b int"), spark.createDataFrame([(1, 7, 8), (2, 9, None)], "k int, a int, c int"), "k").orderBy("k").collect()
    assert [r[:] for r in both] == [(1, 7, 5, 8), (2, 9, None, None)]
    runs = spark.createDataFrame([("g", "x", 0.5), ("g", "a", 0.5), ("h", "b", None)], "grp string, name string, auc double")
    assert [r[:] for r in X.best_run(runs, "grp", "auc", "name").collect()] == [("g", "a", 0.5)]
    assert X.outcomes(spark.createDataFrame([("j", True), ("j", None)], "j string, ok boolean"), "j", "ok").first()[1:] == (1, 1, 0.5)
    a = spark.createDataFrame([("r", 5, 1.0), ("r", 8, 2.0), ("q", 1, 1.0)], "run string, at long, value double")
    b = spark.createDataFrame([("r", 4, 1.0), ("r", 6, 2.0), ("r", 9, 3.0)], "run string, at long, value double")
    assert sorted((r.at, r.near_at) for r in X.nearest_step(a, b, "run", "at").collect()) == [(5, 4.0), (8, 9.0)]


def test_files(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"id": "1", "term": "a", "types": ["x"]}, {"id": "2", "term": "b", "types": "y"}, {"term": "c"}]))
    assert [r.types for r in files.read_terms(spark, str(tmp_path / "t.json")).orderBy("term").collect()] == [["x"], ["y"], None]
    (tmp_path / "r.json").write_text('[{"ID": "1", "parent": "p", "child": "c"}, [4, 5]]')
    assert {(r.parent, r.parent_id, r.child_id) for r in files.read_relations(spark, str(tmp_path / "r.json")).collect()} == {("p", None, None), (None, 4, 5)}
    (tmp_path / "l.txt").write_text(" a \n\nb\na\n")
    assert {r.term for r in files.read_lines(spark, str(tmp_path / "l.txt")).collect()} == {"a", "b"}
    np.save(tmp_path / "m.npy", np.array([[1.0, 2], [3, 4]]))
    assert {(r.i, r.j): r.score for r in files.read_matrix(spark, str(tmp_path / "m.npy")).collect()} == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4}
    (tmp_path / "w.csv").write_text(",x,y\na,1,2\n")
    assert {(r.term, r.other, r.score) for r in files.read_wide(spark, str(tmp_path / "w.csv")).collect()} == {("a", "x", 1.0), ("a", "y", 2.0)}
    assert files.read_few_shot(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "e.json").write_text(json.dumps([{"id": 1, "text_description": "a", "embedding": [1.0]}]))
    assert files.read_entities(spark, str(tmp_path / "e.json")).first().dataset == "default"
    (tmp_path / "bad.json").write_text(json.dumps([{"id": 1, "text_description": "a"}]))
    with pytest.raises(Exception, match="entity without"):
        files.read_entities(spark, str(tmp_path / "bad.json")).collect()
    pairs = spark.createDataFrame([("c", "p")], "child string, parent string")
    files.write_relations(pairs, str(tmp_path / "out"), {"n": 1})
    assert json.loads((tmp_path / "out/relationships.json").read_text())[0]["ID"].startswith("REL_")
    files.write_bundle(str(tmp_path / "bundle"), pairs=pairs)
    assert files.read_bundle(spark, str(tmp_path / "bundle"), "pairs")["pairs"].count() == 1
    assert {files.edge_lines(pairs, h).first().line for h in ("csv", "dot")} == {"c,p", '"c" -> "p";'}
    files.zip_json(pairs, str(tmp_path / "z.zip"))
    with pytest.raises(ValueError):
        files.zip_json(pairs.union(pairs), str(tmp_path / "z.zip"), most=1)
    scores = files.read_matrix(spark, str(tmp_path / "m.npy"))
    files.write_matrix(scores, str(tmp_path / "n.npy"), (2, 2))
    assert (np.load(tmp_path / "n.npy") == [[1, 2], [3, 4]]).all()
    with pytest.raises(ValueError):
        files.write_matrix(scores, str(tmp_path / "n.npy"), (2, 2), most=3)
    files.write_wide(spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0)], "term string, other string, score double"), str(tmp_path / "wide"))
    assert {(r.term, r.other, r.score) for r in files.read_wide(spark, str(tmp_path / "wide")).collect()} == {("a", "x", 1.0), ("a", "y", 2.0)}
    files.write_json(pairs, str(tmp_path / "table")), pairs.write.parquet(str(tmp_path / "t"))
    files.replace_table(spark.read.parquet(str(tmp_path / "t")).withColumn("more", F.lit(1)), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["child", "parent", "more"]
    files.write_document(pairs, pairs.select(F.col("child").alias("node")), "dot", str(tmp_path / "dot"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "dot").glob("part-*"))).split("\n")[:3] == ["digraph {", '"c";', '"c" -> "p";']
    assert files.read_bundle(spark, str(tmp_path / "bundle")).keys() == {"pairs"}
    assert "| c | p |" in files.markdown_report(pairs, "x")
    with pytest.raises(ValueError):
        files.markdown_report(pairs.union(pairs), "x", most=1)
    made = []
    for _ in range(2):
        files.reuse(spark, str(tmp_path / "kept"), lambda: made.append(1) or pairs)
    assert made == [1]
    (tmp_path / "D/train").mkdir(parents=True)
    (tmp_path / "D/train/d_train.json").write_text(json.dumps([{"term": "a", "types": ["x"], "RAG": [{"term": "q", "types": ["y"], "similarity": 0.5}]}, {"id": "7", "term": "b", "types": "z"}]))
    domain = files.read_domains(spark, str(tmp_path), ["D", "None"])
    assert {(r.id, r.term, r.domain) for r in domain.collect()} == {("0", "a", "D"), ("7", "b", "D")} and files.read_domains(spark, str(tmp_path), ["None"]) is None
    assert any("'q' → Types: ['y']" in r.text for r in files.training_texts(domain).collect())
    assert files.first_file(spark, str(tmp_path), "n", ".npy").endswith("n.npy") and files.first_file(spark, str(tmp_path / "gone")) is None
    assert files.read_examples(spark, [{"phrases_1": ["a"], "phrases_2": ["b"], "labels": [[1]]}]).first()["labels"] == [[1.0]]
    (tmp_path / "x.csv").write_text("run,auc\na,0.5\n")
    assert files.read_experiments(spark, str(tmp_path / "x.csv")).first().auc == 0.5
    (tmp_path / "runs/b").mkdir(parents=True), (tmp_path / "runs/.hidden").mkdir(), (tmp_path / "runs/grid_search_1").mkdir()
    assert [r.run for r in files.list_runs(spark, str(tmp_path / "runs")).collect()] == ["b"]


def test_stream_equals_batch(spark):
    src = f"{SF}/events.parquet"
    batch = spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = spark.readStream.schema(spark.read.parquet(src).schema).format("parquet").option("pathGlobFilter", "events.parquet").load(SF).withColumn("ts", F.col("ts").cast("timestamp"))
    q = windows.tumbling(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    time.sleep(0.2)
    got = {tuple(r)[:3] for r in spark.table("tumbled").collect()}
    assert got == {tuple(r)[:3] for r in windows.tumbling(batch, "ts", "event_type").collect()}
    assert windows.deduplicated(batch.union(batch), "ts", "event_id").count() == batch.count()


def _norm(v):
    if isinstance(v, float):
        return None if np.isnan(v) else round(v, 6) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", ["rag_topk", "roc_auc", "threshold_sweep", "resolve_relations", "split_relations", "clustering_coefficient", "nearest_asof", "p2_found", "p6_found"])
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("embeddings", "entities", "relations", "relation_pairs", "top_terms", "events", "terms_train", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cur = c.execute(registry.oracle_sql()[name])
    at = [[x[0] for x in cur.description].index(n) for n in df.columns]
    want = sorted(repr([_norm(r[i]) for i in at]) for r in cur.fetchall())
    assert sorted(repr([_norm(v) for v in r]) for r in df.collect()) == want

"""Queries of the reference operators over whole tables, and their SQL.

Floats are rounded in both; arrays are sorted or joined to text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ontospark.functions import prompts as P
from ontospark.functions import vector as V
from ontospark.functions.text import term_key
from ontospark.operators import experiments as X
from ontospark.operators import graph as G
from ontospark.operators import metrics as M
from ontospark.operators import relations as R
from ontospark.operators import similarity as S
from ontospark.operators.components import connected_components
from ontospark.operators.hierarchy import term_links
from ontospark.operators.order import numbered
from ontospark.runtime import dataset_key, table
from ontospark.sources.files import edge_lines, with_relation_ids
from ontospark.streaming import windows as W

THRESHOLDS = [0.01 + i * 0.01 for i in range(94)]
Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _emb(s, d) -> DataFrame:
    return table(s, d, "embeddings")


def _r(c, n: int = 6):
    return F.round(c, n)


def _top(s, d, k: int = 10) -> DataFrame:
    e = _emb(s, d)
    return S.top_k(e, e, "vec_id", "embedding", k)


_DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_TOP = f"""
WITH sc AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj, {_DOT} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS rank FROM sc QUALIFY rank <= 10)
"""


@query("rag_topk", _TOP + "SELECT i AS vec_id, rank, j AS near_id, lj AS near_label, round(score, 6) AS score FROM t")
def _(s, d):
    lab = _emb(s, d).select(F.col("vec_id").alias("j"), F.col("label").alias("near_label"))
    return _top(s, d).join(lab, "j").select(F.col("i").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.col("j").alias("near_id"), "near_label", _r("score").alias("score"))


@query("rag_label_vote", _TOP + """, v AS (SELECT i, lj, count(*) AS n FROM t GROUP BY i, lj)
SELECT i AS vec_id, arg_min(lj, row(-n, lj)) AS voted, max(n) AS votes FROM v GROUP BY i""")
def _(s, d):
    lab = _emb(s, d).select(F.col("vec_id").alias("j"), F.col("label").alias("lj"))
    v = _top(s, d).join(lab, "j").groupBy("i", "lj").agg(F.count("*").alias("n"))
    return v.groupBy(F.col("i").alias("vec_id")).agg(F.min_by("lj", F.struct(-F.col("n"), "lj")).alias("voted"), F.max("n").alias("votes"))


@query("rag_stats", _TOP + """, c AS (SELECT i, count(*) AS n FROM t GROUP BY i)
SELECT count(*) AS terms, min(n) AS low, max(n) AS high, round(avg(n), 6) AS mean, count(*) FILTER (n = 10) AS full_lists, count(*) FILTER (n <> 10) AS short_lists FROM c""")
def _(s, d):
    c = _top(s, d).groupBy("i").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("terms"), F.min("n").alias("low"), F.max("n").alias("high"), _r(F.avg("n")).alias("mean"), F.count_if(F.col("n") == 10).alias("full_lists"), F.count_if(F.col("n") != 10).alias("short_lists"))


_SPLIT = """
WITH h AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(vec_id AS VARCHAR), ':42')), vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
sp AS (SELECT *, CASE WHEN n >= 2 AND r <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS side FROM h)
"""


@query("split_per_group", _SPLIT + "SELECT vec_id, label, side FROM sp")
def _(s, d):
    return R.split_groups(_emb(s, d), "vec_id", "label").select(F.col("id").alias("vec_id"), F.col("grp").alias("label"), "side")


@query("rag_test_train", _SPLIT + """SELECT a.vec_id, b.vec_id AS near_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rank
FROM sp a JOIN sp b ON a.side = 'test' AND b.side = 'train' QUALIFY rank <= 10""")
def _(s, d):
    e = _emb(s, d)
    side = R.split_groups(e, "vec_id", "label").select(F.col("id").alias("vec_id"), "side")
    e = e.join(side, "vec_id")
    t = S.top_k(e.filter("side = 'test'"), e.filter("side = 'train'"), "vec_id", "embedding", 10, skip_self=False)
    return t.select(F.col("i").alias("vec_id"), F.col("j").alias("near_id"), F.col("rank").cast("long").alias("rank"))


_PAIRS = f"WITH sc AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label = b.label AS same, {_DOT} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)\n"


@query("similarity_pairs_threshold", _PAIRS + "SELECT i, j, round(score, 6) AS score FROM sc WHERE score > 0.25")
def _(s, d):
    return S.pairs(_emb(s, d), "vec_id", "embedding", above=0.25).select("i", "j", _r("score").alias("score"))


@query("similarity_topn_global", _PAIRS + "SELECT i, j, round(score, 6) AS score FROM sc WHERE i < j ORDER BY sc.score DESC, i, j LIMIT 20")
def _(s, d):
    return S.highest_pairs(_emb(s, d), "vec_id", "embedding", 20).select("i", "j", _r("score").alias("score"))


def _all(s, d, labels: bool = True, **options) -> S.PairScores:
    return S.PairScores(_emb(s, d), "vec_id", "embedding", "label" if labels else None, **options)


@query("score_stats", _PAIRS + "SELECT count(*) AS n, round(min(score), 6) AS low, round(max(score), 6) AS high, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM sc")
def _(s, d):
    return _all(s, d, False).stats().select("n", *[_r(c).alias(c) for c in ("low", "high", "mean", "std")])


@query("score_histogram", _PAIRS + """, r AS (SELECT round(score, 6) AS s FROM sc), m AS (SELECT min(s) AS lo, max(s) AS hi FROM r)
SELECT CAST(least(floor((s - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, count(*) AS n FROM r, m GROUP BY 1""")
def _(s, d):
    return _all(s, d, False, shape=_six).histogram()


@query("score_ecdf", _PAIRS + "SELECT s AS score, round(sum(count(*)) OVER (ORDER BY s) / sum(count(*)) OVER (), 6) AS share FROM (SELECT round(score, 3) + 0.0 AS s FROM sc) GROUP BY s")
def _(s, d):
    return M.ecdf_of_counts(_all(s, d, False).values(3)).select("score", _r("share").alias("share"))


def _six(x):
    return np.round(x, 6)


def _swept(s, d, cuts: list[float]) -> DataFrame:
    return M.sweep_counts(_all(s, d).passed(cuts), cuts)


_GRID = "g AS (SELECT i AS pos, 0.01::DOUBLE + i * 0.01::DOUBLE AS threshold FROM range(94) r(i))"
_SWEEP = _PAIRS + f""", {_GRID}, c AS (
  SELECT threshold, count(*) FILTER (score > threshold AND same) AS tp, count(*) FILTER (score > threshold AND NOT same) AS fp,
    count(*) FILTER (score <= threshold AND NOT same) AS tn, count(*) FILTER (score <= threshold AND same) AS fn FROM sc, g GROUP BY threshold),
m AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m)
"""


@query("threshold_sweep", _SWEEP + "SELECT round(threshold, 6) AS threshold, tp, fp, tn, fn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def _(s, d):
    m = _swept(s, d, THRESHOLDS)
    return m.select(*[_r(c).alias(c) for c in ("threshold", "accuracy", "precision", "recall", "f1")], "tp", "fp", "tn", "fn")


@query("best_thresholds", _SWEEP + """, l AS (UNPIVOT (SELECT threshold, accuracy, precision, recall, f1 FROM f) ON accuracy, precision, recall, f1 INTO NAME metric VALUE value)
SELECT metric, round(arg_min(threshold, row(-value, threshold)), 6) AS threshold, round(max(value), 6) AS value FROM l GROUP BY metric""")
def _(s, d):
    return M.best_thresholds(_swept(s, d, THRESHOLDS)).select("metric", _r("threshold").alias("threshold"), _r("value").alias("value"))


@query("fixed_threshold_metrics", _SWEEP.replace("FROM range(94) r(i))", "FROM range(0)r(i) UNION ALL SELECT 0, unnest([0.05, 0.15, 0.25, 0.5]::DOUBLE[]))") + "SELECT threshold, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1 FROM f")
def _(s, d):
    return _swept(s, d, [0.05, 0.15, 0.25, 0.5]).select("threshold", _r("accuracy").alias("accuracy"), _r("f1").alias("f1"))


@query("share_above", _SWEEP + "SELECT round(threshold, 6) AS threshold, round((tp + fp) / (tp + fp + tn + fn), 6) AS share FROM f")
def _(s, d):
    return _swept(s, d, THRESHOLDS).select(_r("threshold").alias("threshold"), _r((F.col("tp") + F.col("fp")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))).alias("share"))


@query("roc_auc", _PAIRS + """, u AS (SELECT round(score, 9) AS s, same FROM sc), k AS (SELECT s, count(*) FILTER (same) AS p, count(*) FILTER (NOT same) AS n FROM u GROUP BY s),
b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM k)
SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc, sum(p)::BIGINT AS pos, sum(n)::BIGINT AS neg FROM b""")
def _(s, d):
    return S.pair_auc(_all(s, d)).select(_r("auc").alias("auc"), "pos", "neg")


@query("weighted_bce", _PAIRS + """, p AS (SELECT same, (round(score, 6) + 1) / 2 AS p FROM sc)
SELECT round(avg(-ln(p)) FILTER (same) / count(*) FILTER (same) + avg(-ln(1 - p)) FILTER (NOT same) / count(*) FILTER (NOT same), 9) AS loss, count(*) FILTER (same) AS n1, count(*) FILTER (NOT same) AS n0 FROM p""")
def _(s, d):
    return _all(s, d, shape=lambda x: (np.round(x, 6) + 1) / 2).losses().select(_r("loss", 9).alias("loss"), "n1", "n0")


def _cutoff(s, d) -> tuple[float, float]:
    """Share of pairs with one label, and the score at that share from the top of all, the diagonal included."""
    n = _all(s, d).passed([]).first()
    ratio = n.pos / (n.pos + n.neg)
    return ratio, _all(s, d, False, diagonal=True).percentile(1 - ratio)


_ALLPAIRS = f"WITH sc AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label = b.label AS same, {_DOT} AS score FROM embeddings a, embeddings b), q AS (SELECT avg(CAST(same AS DOUBLE)) AS r FROM sc WHERE i <> j), l AS (SELECT list_sort(list(score)) AS l FROM sc), w AS (SELECT r, l, (len(l) - 1) * (1 - r) AS pos FROM q, l), z AS (SELECT r, l[CAST(floor(pos) AS BIGINT) + 1] + (pos - floor(pos)) * (l[CAST(floor(pos) AS BIGINT) + 2] - l[CAST(floor(pos) AS BIGINT) + 1]) AS cut FROM w)\n"


@query("percentile_cutoff", _ALLPAIRS + "SELECT round_even(cut, 3) AS cut, round(r * 100, 6) AS ratio FROM z")
def _(s, d):
    ratio, cut = _cutoff(s, d)
    return s.createDataFrame([(cut,)], "cut double").select(P.round3(F.col("cut")).alias("cut"), _r(F.lit(ratio * 100)).alias("ratio"))


@query("relations_by_percentile", _ALLPAIRS + "SELECT i, count(*) AS n FROM sc, z WHERE i <> j AND score > round_even(cut, 3) GROUP BY i")
def _(s, d):
    cut = s.createDataFrame([(_cutoff(s, d)[1],)], "cut double").select(P.round3(F.col("cut"))).first()[0]
    return _all(s, d, False).above(cut)


@query("l2_normalize", "SELECT id, round(list_sum(list_transform(x, lambda v: v * v)), 6) AS square, round(x[1], 6) AS first FROM (SELECT id, list_transform(CAST(embedding AS DOUBLE[]), lambda v: v / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS x FROM entities WHERE len(embedding) = 128 AND NOT list_contains(list_transform(embedding, lambda v: isnan(v)), true) AND list_max(list_transform(embedding, lambda v: abs(v))) > 0)")
def _(s, d):
    e = table(s, d, "entities").filter("size(embedding) = 128 and not exists(embedding, v -> isnan(v)) and exists(embedding, v -> v <> 0)")
    return e.select("id", V.l2_normalize(F.col("embedding")).alias("x")).select("id", _r(V.dot(F.col("x"), F.col("x"))).alias("square"), _r(F.col("x")[0]).alias("first"))


@query("rms_norm", "SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: v / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / len(embedding) + 1e-6))), 6) AS total FROM embeddings")
def _(s, d):
    return _emb(s, d).select("vec_id", _r(F.aggregate(V.rms_norm(F.col("embedding")), F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("head_split", "SELECT vec_id, h AS head, round(list_sum(list_transform(CAST(embedding AS DOUBLE[])[h * 16 + 1:h * 16 + 16], lambda v: v)), 6) AS total, h // 2 AS kv FROM embeddings, range(4) r(h)")
def _(s, d):
    e = _emb(s, d).select("vec_id", F.posexplode(V.heads(V.doubles(F.col("embedding")), 4)).alias("head", "x"))
    return e.select("vec_id", F.col("head").cast("long").alias("head"), _r(F.aggregate("x", F.lit(0.0), lambda a, x: a + x)).alias("total"), V.kv_head(F.col("head"), 4, 2).cast("long").alias("kv"))


@query("embedding_dims", "SELECT len(embedding) AS dim, count(*) AS n FROM entities GROUP BY 1")
def _(s, d):
    return table(s, d, "entities").groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count("*").alias("n"))


def _attention_sql(block: str) -> str:
    return f"""
WITH v AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // {block} AS blk, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / len(embedding) + 1e-6)) AS x FROM embeddings),
h AS (SELECT vec_id, blk, g, x[g * 16 + 1:g * 16 + 16] AS x FROM v, range(4) r(g)),
e AS (SELECT a.vec_id AS i, b.vec_id AS j, b.blk, a.g, exp(list_dot_product(a.x, b.x) * 0.25) AS e FROM h a JOIN h b ON a.g = b.g),
p AS (SELECT i, j, e / sum(e) OVER (PARTITION BY i, g, blk) AS p FROM e)
SELECT i, j, round(avg(p), 6) AS score FROM p GROUP BY i, j HAVING avg(p) > """


@query("attention_block_softmax", _attention_sql("64") + "0.05")
def _(s, d):
    return S.attention(_emb(s, d), "vec_id", "embedding", 4, 64, above=0.05).select("i", "j", _r("score").alias("score"))


@query("attention_global_softmax", _attention_sql("1000000") + "0.006")
def _(s, d):
    return S.attention(_emb(s, d), "vec_id", "embedding", 4, None, above=0.006).select("i", "j", _r("score").alias("score"))


@query("threshold_or_argmax", """
WITH c AS (SELECT label, list(m ORDER BY k) AS c FROM (SELECT label, k, avg(CAST(embedding[k] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(k) GROUP BY label, k) GROUP BY label),
s AS (SELECT vec_id, c.label, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), c.c), 9) AS s FROM embeddings e, c)
SELECT vec_id, CASE WHEN count(*) FILTER (s > 0.2) > 0 THEN array_to_string(list_sort(list(label) FILTER (s > 0.2)), ',') ELSE CAST(arg_min(label, row(-s, label)) AS VARCHAR) END AS labels FROM s GROUP BY vec_id""")
def _(s, d):
    e = _emb(s, d)
    mean = e.select("label", F.posexplode(V.doubles(F.col("embedding"))).alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("x"))
    centre = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda v: v["x"]).alias("c"))
    scores = e.select("vec_id", "embedding").join(F.broadcast(centre)).select("vec_id", "label", _r(V.dot(F.col("embedding"), F.col("c")), 9).alias("s"))
    return M.pick_labels(scores, "vec_id", "label", "s", 0.2).select("vec_id", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


def _typings(s, d) -> DataFrame:
    t = table(s, d, "terms_train").select(term_key(F.col("term")).alias("k"), "row_pos", F.sort_array(F.array_distinct(F.coalesce("types", F.array().cast("array<string>")))).alias("types")).filter("k <> ''")
    both = t.groupBy("k").agg(F.min_by("types", "row_pos").alias("guess"), F.max_by("types", "row_pos").alias("truth"), F.count("*").alias("n"))
    return both.filter("n > 1")


_K = r"lower(trim(regexp_replace({}, '[ \t\r\n]+', ' ', 'g')))"
_TYPES = f"""
WITH t AS (SELECT {_K.format('term')} AS k, row_pos, list_sort(list_distinct(coalesce(types, []))) AS types FROM terms_train),
p AS (SELECT k, arg_min(types, row_pos) AS g, arg_max(types, row_pos) AS t FROM t WHERE k <> '' GROUP BY k HAVING count(*) > 1)
"""


@query("multilabel_example_metrics", _TYPES + """, m AS (SELECT len(list_intersect(t, g)) AS b, len(list_distinct(list_concat(t, g))) AS o, len(t) + len(g) AS a FROM p)
SELECT round(avg(CASE WHEN o = 0 THEN 1.0 ELSE b / o END), 6) AS jaccard, round(avg(CASE WHEN o = 0 THEN 1.0 ELSE 2 * b / a END), 6) AS f1, round(avg(CAST(b = o AS DOUBLE)), 6) AS exact, count(*) AS n FROM m""")
def _(s, d):
    return M.set_metrics(_typings(s, d), "truth", "guess").select(*[_r(c).alias(c) for c in ("jaccard", "f1", "exact")], "n")


@query("multilabel_weighted_prf", _TYPES + """, l AS (SELECT t, g, unnest(list_distinct(list_concat(t, g))) AS x FROM p),
c AS (SELECT x, count(*) FILTER (list_contains(t, x) AND list_contains(g, x)) AS tp, count(*) FILTER (list_contains(t, x)) AS s, count(*) FILTER (list_contains(g, x)) AS q FROM l GROUP BY x),
r AS (SELECT s, coalesce(tp / nullif(q, 0), 0) AS p, coalesce(tp / nullif(s, 0), 0) AS r FROM c)
SELECT round(sum(p * s) / sum(s), 6) AS precision, round(sum(r * s) / sum(s), 6) AS recall, round(sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * s) / sum(s), 6) AS f1, sum(s)::BIGINT AS support FROM r""")
def _(s, d):
    return M.label_metrics(_typings(s, d), "truth", "guess").select(*[_r(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("label_vocabulary", "SELECT label, row_number() OVER (ORDER BY label) - 1 AS pos, n FROM (SELECT x AS label, count(*) AS n FROM (SELECT unnest(list_distinct(types)) AS x FROM terms_train) GROUP BY x)")
def _(s, d):
    v = table(s, d, "terms_train").select(F.explode(F.array_distinct("types")).alias("label")).filter("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    return numbered(v, "label")


def _links(s, d) -> DataFrame:
    r = table(s, d, "relations").select("rel_id", term_key(F.col("parent")).alias("parent"), term_key(F.col("child")).alias("child"))
    return r.filter("parent <> '' and child <> '' and parent is not null and child is not null").distinct()


def _names(s, d) -> DataFrame:
    e = table(s, d, "entities").select("id", term_key(F.col("text_description")).alias("t"))
    return R.last_by_text(e, "t", "id")


_LINK = f"""
WITH l AS (SELECT DISTINCT rel_id, {_K.format('parent')} AS parent, {_K.format('child')} AS child FROM relations WHERE {_K.format('parent')} <> '' AND {_K.format('child')} <> ''),
e AS (SELECT {_K.format('text_description')} AS t, max(id) AS id FROM entities WHERE {_K.format('text_description')} <> '' GROUP BY 1),
r AS (SELECT l.*, p.id AS parent_id, c.id AS child_id FROM l LEFT JOIN e p ON p.t = l.parent LEFT JOIN e c ON c.t = l.child),
g AS (SELECT id, CASE WHEN trim(coalesce(dataset, '')) = '' THEN 'default' ELSE lower(trim(dataset)) END AS grp FROM entities),
k AS (SELECT DISTINCT a.grp, parent_id, child_id FROM r JOIN g a ON a.id = parent_id JOIN g b ON b.id = child_id WHERE a.grp = b.grp)
"""


@query("resolve_relations", _LINK + "SELECT DISTINCT rel_id, parent_id, child_id FROM r WHERE parent_id IS NOT NULL AND child_id IS NOT NULL")
def _(s, d):
    return R.resolve(_links(s, d), _names(s, d)).filter("parent_id is not null and child_id is not null").select("rel_id", "parent_id", "child_id").distinct()


@query("skipped_relations", _LINK + "SELECT count(*) AS total, count(*) FILTER (parent_id IS NULL) AS no_parent, count(*) FILTER (child_id IS NULL) AS no_child FROM r")
def _(s, d):
    return R.resolve(_links(s, d), _names(s, d)).agg(F.count("*").alias("total"), F.count_if(F.col("parent_id").isNull()).alias("no_parent"), F.count_if(F.col("child_id").isNull()).alias("no_child"))


def _groups(s, d) -> DataFrame:
    return table(s, d, "entities").select("id", dataset_key("dataset").alias("grp"))


def _in_group(s, d) -> DataFrame:
    r = R.resolve(_links(s, d), _names(s, d)).filter("parent_id is not null and child_id is not null")
    return R.in_one_group(r.select("parent_id", "child_id"), _groups(s, d))


@query("same_group_relations", _LINK + "SELECT * FROM k")
def _(s, d):
    return _in_group(s, d)


@query("dataset_weights", _LINK + ", n AS (SELECT grp, count(k.child_id) AS n FROM (SELECT DISTINCT grp FROM g) LEFT JOIN k USING (grp) GROUP BY grp) SELECT grp, n, round(n / sum(n) OVER (), 6) AS weight FROM n")
def _(s, d):
    return R.group_weights(_in_group(s, d), _groups(s, d)).select("grp", "n", _r("weight").alias("weight"))


def _pairs(s, d) -> DataFrame:
    return table(s, d, "relation_pairs").filter("parent_id is not null and child_id is not null").select("parent_id", "child_id").distinct()


_PAIR = "WITH p AS (SELECT DISTINCT parent_id, child_id FROM relation_pairs WHERE parent_id IS NOT NULL AND child_id IS NOT NULL)\n"


@query("child_to_parents", _PAIR + "SELECT child_id, array_to_string(list_sort(list(parent_id)), ',') AS parents FROM p GROUP BY child_id")
def _(s, d):
    return R.child_parents(_pairs(s, d)).select("child_id", F.array_join(F.col("parents").cast("array<string>"), ",").alias("parents"))


_SIDES = """, h AS (SELECT id, row_number() OVER (PARTITION BY grp ORDER BY md5(concat(CAST(id AS VARCHAR), ':42')), id) AS r, count(*) OVER (PARTITION BY grp) AS n FROM (SELECT id, CASE WHEN trim(coalesce(dataset, '')) = '' THEN 'default' ELSE lower(trim(dataset)) END AS grp FROM entities)),
sd AS (SELECT id, CASE WHEN n >= 2 AND r <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS side FROM h)
"""


@query("split_relations", _PAIR + _SIDES + "SELECT CASE WHEN a.side = b.side THEN a.side ELSE 'mixed' END AS side, count(*) AS n FROM p JOIN sd a ON a.id = parent_id JOIN sd b ON b.id = child_id GROUP BY 1")
def _(s, d):
    sides = R.split_groups(_groups(s, d), "id", "grp").select("id", "side")
    return R.split_relations(_pairs(s, d), sides).groupBy("side").agg(F.count("*").alias("n"))


_U = "(CAST(('0x' || substr(md5(concat(CAST({} AS VARCHAR), ':42')), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0"


@query("uniform_sample", f"SELECT o_orderkey FROM orders ORDER BY {_U.format('o_orderkey')}, o_orderkey LIMIT 100")
def _(s, d):
    return R.sample_uniform(table(s, d, "orders"), "o_orderkey", 100).select("o_orderkey")


@query("weighted_sample", f"SELECT p_partkey FROM part WHERE p_size > 0 ORDER BY -ln({_U.format('p_partkey')}) / p_size, p_partkey LIMIT 100")
def _(s, d):
    return R.sample_weighted(table(s, d, "part"), "p_partkey", "p_size", 100).select("p_partkey")


@query("replacement_sample", f"WITH n AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) SELECT i AS draw, n.c_custkey AS id FROM range(50) r(i) JOIN n ON n.pos = CAST(floor({_U.format('i')} * (SELECT count(*) FROM customer)) AS BIGINT)")
def _(s, d):
    return R.sample_with_replacement(table(s, d, "customer"), "c_custkey", 50)


@query("weighted_dataset_choice", f"""WITH g AS (SELECT source AS grp, count(*) / sum(count(*)) OVER () AS w FROM documents WHERE source IS NOT NULL GROUP BY source), c AS (SELECT grp, sum(w) OVER (ORDER BY grp) AS hi, sum(w) OVER (ORDER BY grp) - w AS lo FROM g)
SELECT i AS draw, grp FROM range(200) r(i) JOIN c ON {_U.format('i')} > lo AND {_U.format('i')} <= hi""")
def _(s, d):
    n = table(s, d, "documents").filter("source is not null").groupBy(F.col("source").alias("grp")).agg(F.count("*").alias("n"))
    w = n.select("grp", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("weight"))
    return R.choose_group(w, s.range(200).select(F.col("id").alias("draw")), "weighted")


@query("relation_matrix", f"""{_PAIR}, c AS (SELECT child_id FROM (SELECT DISTINCT child_id FROM p) ORDER BY {_U.format('child_id')}, child_id LIMIT 32), q AS (SELECT parent_id FROM (SELECT DISTINCT parent_id FROM p) ORDER BY {_U.format('parent_id')}, parent_id LIMIT 32)
SELECT c.child_id, q.parent_id, CASE WHEN p.child_id IS NULL THEN 0 ELSE 1 END AS y FROM c CROSS JOIN q LEFT JOIN p ON p.child_id = c.child_id AND p.parent_id = q.parent_id""")
def _(s, d):
    p = _pairs(s, d)
    pick = lambda c: R.sample_uniform(p.select(c).distinct(), c, 32).select(F.col(c).alias("id"))
    return R.relation_matrix(pick("child_id"), pick("parent_id"), p)


@query("validate_entities", "SELECT count(*) AS total, count(*) FILTER (len(embedding) > 0 AND trim(coalesce(text_description, '')) <> '') AS valid, count(DISTINCT len(embedding)) FILTER (len(embedding) > 0) AS dims, count(DISTINCT dataset) AS datasets, count(DISTINCT len(embedding)) FILTER (len(embedding) > 0) = 1 AS consistent FROM entities")
def _(s, d):
    return R.entity_report(table(s, d, "entities"))


@query("entity_issues", "SELECT id, CASE WHEN len(embedding) = 0 THEN 'no embedding' ELSE 'no text' END AS issue FROM entities WHERE len(embedding) = 0 OR trim(coalesce(text_description, '')) = ''")
def _(s, d):
    return R.entity_issues(table(s, d, "entities"))


@query("validate_relations", "SELECT count(*) AS total, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS valid, count(DISTINCT CASE WHEN parent_id IS NOT NULL AND child_id IS NOT NULL THEN (parent_id, child_id) END) AS distinct_pairs, count(*) FILTER (parent_id IS NOT NULL AND a.id IS NULL) AS unknown_parent, count(*) FILTER (child_id IS NOT NULL AND b.id IS NULL) AS unknown_child FROM relation_pairs LEFT JOIN entities a ON a.id = parent_id LEFT JOIN entities b ON b.id = child_id")
def _(s, d):
    return R.relation_report(table(s, d, "relation_pairs"), table(s, d, "entities").select("id"))


@query("prompt_texts", "SELECT row_pos, concat('Instruct: Given a term, predict its semantic types\nQuery: ', term) AS instruction, concat('Term: ', term, ', Types: ', array_to_string(types, ', ')) AS labelled FROM terms_train WHERE term IS NOT NULL AND types IS NOT NULL")
def _(s, d):
    t = table(s, d, "terms_train").filter("term is not null and types is not null")
    return t.select("row_pos", P.instruction(F.col("term")).alias("instruction"), P.term_text(F.col("term"), F.col("types")).alias("labelled"))


@query("extract_types_regex", "SELECT row_pos, array_to_string(list_sort(list_distinct(types)), ',') AS found FROM terms_train WHERE types IS NOT NULL AND term IS NOT NULL UNION ALL SELECT row_pos, '' FROM terms_train WHERE types IS NULL AND term IS NOT NULL")
def _(s, d):
    t = table(s, d, "terms_train").filter("term is not null")
    said = F.concat(F.lit("Well, {x} then "), F.when(F.col("types").isNotNull(), F.to_json(F.struct(F.col("term").alias("reasoning"), "types"))).otherwise("no answer"), F.lit(" so."))
    return t.select("row_pos", F.array_join(P.extract_types(F.replace(said, F.lit("{x}"), F.lit("x"))), ",").alias("found"))


@query("parse_json_props", "SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def _(s, d):
    return table(s, d, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("path_parts", "SELECT doc_id, concat('data/', coalesce(source, 'none'), '/', CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE 'other' END, '/metrics_step_', doc_id, '.json') AS path, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE 'unknown' END AS part, doc_id::INTEGER AS step FROM documents WHERE doc_id < 2000000000")
def _(s, d):
    mid = F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "test").otherwise("other")
    path = F.concat(F.lit("data/"), F.coalesce("source", F.lit("none")), F.lit("/"), mid, F.lit("/metrics_step_"), F.col("doc_id").cast("string"), F.lit(".json"))
    return table(s, d, "documents").select("doc_id", path.alias("path")).withColumns({"part": P.split_of(F.col("path")), "step": P.step_of(F.col("path"))})


@query("experiment_grid", "SELECT count(*) AS n, count(DISTINCT (lr, b)) AS pairs, sum(CAST(round_trip AS INTEGER))::BIGINT AS same FROM (SELECT lr, b, true AS round_trip FROM (SELECT unnest([1e-5, 1e-4, 5e-5, 1e-3]) AS lr), (SELECT unnest([16, 32, 64, 128, 256]) AS b), (SELECT unnest([1, 2, 3]) AS seed), (SELECT unnest(['doid', 'obi', 'po']) AS ds))")
def _(s, d):
    g = X.grid(s, lr=[1e-5, 1e-4, 5e-5, 1e-3], b=[16, 32, 64, 128, 256], seed=[1, 2, 3], ds=["doid", "obi", "po"])
    name = P.run_name(F.lit("2025-07-11 19:18:06").cast("timestamp_ntz"), F.col("ds"), F.lit(10), F.col("lr"), F.col("b"), F.lit(100), F.col("seed"))
    p = g.select("*", P.parse_run(name).alias("p"))
    same = F.expr("p.dataset = ds and p.lr = lr and p.batch = b and p.seed = seed").cast("int")
    return p.agg(F.count("*").alias("n"), F.count_distinct("lr", "b").alias("pairs"), F.sum(same).alias("same"))


def _log(s, d) -> DataFrame:
    return table(s, d, "events").select("event_type", F.col("event_id").alias("step"), "value", "user_id")


_W = "OVER (PARTITION BY event_type ORDER BY event_id"


@query("moving_average", f"SELECT event_type, event_id AS step, round(a, 6) AS average FROM (SELECT *, avg(value) {_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a, row_number() {_W}) AS n FROM events) WHERE n >= 5")
def _(s, d):
    return X.moving_average(_log(s, d), "event_type", "step", "value", 5).withColumn("average", _r("average"))


@query("running_best", f"SELECT event_type, event_id AS step, value FROM (SELECT *, max(value) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE b IS NULL OR value > b")
def _(s, d):
    return X.running_best(_log(s, d), "event_type", "step", "value")


@query("last_steps", f"SELECT event_type, event_id AS step FROM events QUALIFY row_number() {_W} DESC) <= 50")
def _(s, d):
    return X.last_steps(_log(s, d), "event_type", "step").select("event_type", "step")


@query("keep_top_k", "SELECT event_type, event_id AS step, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id DESC) <= 2")
def _(s, d):
    return X.keep_top(_log(s, d), "event_type", "value", "step").select("event_type", "step", "value")


@query("log_summary", "SELECT event_type, count(*) AS n, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def _(s, d):
    return X.log_summary(_log(s, d), "event_type", "step", "value").withColumn("mean", _r("mean"))


@query("nearest_asof", """WITH a AS (SELECT user_id, event_id AS at, value FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, event_id AS at, value FROM events WHERE event_type = 'click')
SELECT a.user_id, a.at, arg_min(b.at, row(abs(b.at - a.at), b.at))::DOUBLE AS near_at, round(abs(a.value - arg_min(b.value, row(abs(b.at - a.at), b.at))), 6) AS gap FROM a JOIN b USING (user_id) GROUP BY a.user_id, a.at, a.value""")
def _(s, d):
    e = _log(s, d).select("user_id", F.col("step").alias("at"), "value", "event_type")
    n = X.nearest_step(e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'"), "user_id", "at")
    return n.select("user_id", "at", "near_at", _r(F.abs(F.col("lv") - F.col("near_value"))).alias("gap"))


@query("job_rounds", "SELECT n_name, (row_number() OVER (ORDER BY n_name) - 1) // 4 AS round, (row_number() OVER (ORDER BY n_name) - 1) % 4 AS slot FROM nation")
def _(s, d):
    return X.rounds(table(s, d, "nation").select("n_name"), "n_name").select("n_name", "round", F.col("slot").cast("long").alias("slot"))


def _terms(s, d, c: str) -> DataFrame:
    return table(s, d, "relations").select(term_key(F.col(c)).alias("term")).filter("term <> ''").distinct()


_TERM = f"WITH p AS (SELECT DISTINCT {_K.format('parent')} AS term FROM relations WHERE {_K.format('parent')} <> ''), c AS (SELECT DISTINCT {_K.format('child')} AS term FROM relations WHERE {_K.format('child')} <> '')\n"


@query("union_distinct_terms", _TERM + "SELECT * FROM p UNION SELECT * FROM c")
def _(s, d):
    return _terms(s, d, "parent").union(_terms(s, d, "child")).distinct()


@query("terms_intersect", _TERM + "SELECT * FROM p INTERSECT SELECT * FROM c")
def _(s, d):
    return _terms(s, d, "parent").intersect(_terms(s, d, "child"))


@query("terms_except", _TERM + "SELECT * FROM p EXCEPT SELECT * FROM c")
def _(s, d):
    return _terms(s, d, "parent").exceptAll(_terms(s, d, "child"))


def _tree(s, d) -> DataFrame:
    return term_links(table(s, d, "relations"))


_TREE = f"WITH r AS (SELECT {_K.format('child')} AS c, {_K.format('parent')} AS p, added_at, rel_id FROM relations), l AS (SELECT c AS child, arg_min(p, row(added_at IS NULL, added_at, rel_id IS NULL, rel_id, p)) AS parent FROM r WHERE c <> '' AND p <> '' GROUP BY c)\n"


@query("hierarchy_roles", _TREE + ", n AS (SELECT child AS node FROM l UNION SELECT parent FROM l) SELECT node, CASE WHEN node IN (SELECT child FROM l) AND node IN (SELECT parent FROM l) THEN 'intermediate' WHEN node IN (SELECT child FROM l) THEN 'leaf' ELSE 'root' END AS role FROM n")
def _(s, d):
    l = _tree(s, d)  # noqa: E741
    return G.roles(l, l.select(F.explode(F.array("child", "parent")).alias("node")).distinct())


@query("degree_top", _TREE + "SELECT parent, count(*) AS children FROM l GROUP BY parent ORDER BY children DESC, parent LIMIT 20")
def _(s, d):
    return _tree(s, d).groupBy("parent").agg(F.count("*").alias("children")).orderBy(F.col("children").desc(), "parent").limit(20)


@query("hierarchy_density", _TREE + ", n AS (SELECT count(*) AS n FROM (SELECT child FROM l UNION SELECT parent FROM l)) SELECT n AS nodes, count(*) AS links, round(count(*) / (n * (n - 1.0)), 12) AS density FROM l, n GROUP BY n")
def _(s, d):
    l = _tree(s, d)  # noqa: E741
    n = l.select(F.explode(F.array("child", "parent")).alias("node")).distinct().agg(F.count("*").alias("nodes"))
    return l.agg(F.count("*").alias("links")).join(F.broadcast(n)).select("nodes", "links", F.round(F.try_divide("links", F.col("nodes") * (F.col("nodes") - 1.0)), 12).alias("density"))


@query("short_cycles", _TREE + "SELECT child AS cycle FROM l WHERE child = parent UNION ALL SELECT concat(a.child, ' | ', b.child) FROM l a JOIN l b ON a.parent = b.child AND b.parent = a.child WHERE a.child < b.child UNION ALL SELECT concat(a.child, ' | ', b.child, ' | ', c.child) FROM l a JOIN l b ON a.parent = b.child JOIN l c ON b.parent = c.child AND c.parent = a.child WHERE a.child < b.child AND a.child < c.child AND b.child <> c.child")
def _(s, d):
    return G.short_cycles(_tree(s, d)).select(F.array_join("cycle", " | ").alias("cycle"))


@query("all_cycles", _TREE.replace("WITH r", "WITH RECURSIVE r") + ", w AS (SELECT child AS s, parent AS t, [child] AS path FROM l UNION ALL SELECT s, l.parent, list_append(path, l.child) FROM w JOIN l ON l.child = w.t WHERE w.t > w.s AND NOT list_contains(path, w.t)) SELECT array_to_string(path, ' | ') AS cycle FROM w WHERE t = s")
def _(s, d):
    return G.all_cycles(_tree(s, d)).select(F.array_join("cycle", " | ").alias("cycle"))


_COMPONENTS = """WITH RECURSIVE p AS (SELECT DISTINCT parent_id AS a, child_id AS b FROM relation_pairs WHERE parent_id IS NOT NULL AND child_id IS NOT NULL),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), w AS (SELECT a AS node, a AS low FROM e UNION SELECT e.b, w.low FROM w JOIN e ON e.a = w.node AND w.low < e.b)
SELECT node, min(low) AS component FROM (SELECT node, low FROM w UNION ALL SELECT node, node FROM w) GROUP BY node"""


@query("components", _COMPONENTS)
def _(s, d):
    return connected_components(_pairs(s, d), "parent_id", "child_id")


@query("component_stats", _COMPONENTS.replace("SELECT node, min(low)", ", c AS (SELECT node, min(low)") + "), s AS (SELECT component, count(*) AS n FROM c GROUP BY component) SELECT count(*) AS components, sum(n)::BIGINT AS nodes, max(n) AS largest, round(avg(n), 6) AS mean_size FROM s")
def _(s, d):
    return G.component_stats(connected_components(_pairs(s, d), "parent_id", "child_id")).withColumn("mean_size", _r("mean_size"))


def _near_graph(s, d) -> DataFrame:
    e = _emb(s, d).select("vec_id", F.array(F.col("label").cast("string")).alias("t"))
    t = _top(s, d, 5)
    a, b = e.select(F.col("vec_id").alias("i"), F.col("t").alias("a_types")), e.select(F.col("vec_id").alias("j"), F.col("t").alias("b_types"))
    return G.term_graph(t.join(a, "i").join(b, "j").select(F.col("i").alias("a"), F.col("j").alias("b"), "a_types", "b_types"))


_GRAPH = _TOP + ", g AS (SELECT least(i, j) AS src, greatest(i, j) AS dst, max(CASE WHEN li = lj THEN 1.0 ELSE 0.1 END)::DOUBLE AS weight FROM t WHERE rank <= 5 GROUP BY 1, 2), b AS (SELECT src, dst, weight FROM g UNION ALL SELECT dst, src, weight FROM g)\n"


@query("term_graph_edges", _GRAPH + "SELECT * FROM g")
def _(s, d):
    return _near_graph(s, d)


@query("degree_centrality", _GRAPH + "SELECT src AS node, count(*) AS degree, round(count(*) / ((SELECT count(*) FROM embeddings) - 1), 6) AS centrality FROM b GROUP BY src")
def _(s, d):
    return G.degrees(_near_graph(s, d), _emb(s, d).select(F.col("vec_id").alias("node"))).withColumn("centrality", _r("centrality"))


@query("clustering_coefficient", _GRAPH + """, k AS (SELECT src AS node, count(*) AS d FROM b GROUP BY src), t3 AS (SELECT x.src AS node, count(*) AS t FROM b x JOIN b y ON x.src = y.src AND x.dst < y.dst JOIN g ON g.src = x.dst AND g.dst = y.dst GROUP BY x.src)
SELECT node, round(CASE WHEN d < 2 THEN 0 ELSE 2 * coalesce(t, 0) / (d * (d - 1)) END, 6)::DOUBLE AS coefficient FROM k LEFT JOIN t3 USING (node)""")
def _(s, d):
    return G.clustering(_near_graph(s, d)).withColumn("coefficient", _r("coefficient"))


def _rank_sql(rounds: int) -> str:
    steps = [", o AS (SELECT src, sum(weight) AS total FROM b GROUP BY src), f AS (SELECT b.src, b.dst, weight / total AS share FROM b JOIN o USING (src)), r0 AS (SELECT vec_id AS node, 1.0::DOUBLE / (SELECT count(*) FROM embeddings) AS rank FROM embeddings)"]
    for k in range(rounds):
        steps.append(f", r{k + 1} AS (SELECT r.node, 0.85 * (coalesce(got, 0) + (1 - (SELECT sum(share * rank) FROM f JOIN r{k} q ON q.node = f.src)) / n) + 0.15 / n AS rank FROM r{k} r CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM embeddings) LEFT JOIN (SELECT dst, sum(share * rank) AS got FROM f JOIN r{k} q ON q.node = f.src GROUP BY dst) m ON m.dst = r.node)")
    return "".join(steps) + f" SELECT node, round(rank, 8) AS rank FROM r{rounds}"


@query("pagerank", _GRAPH + _rank_sql(5))
def _(s, d):
    return G.pagerank(_near_graph(s, d), _emb(s, d).select(F.col("vec_id").alias("node")), rounds=5).select("node", F.round("rank", 8).alias("rank"))


@query("pagerank_converged")
def _(s, d):
    return G.pagerank(_near_graph(s, d), _emb(s, d).select(F.col("vec_id").alias("node"))).select("node", F.round("rank", 8).alias("rank"))


@query("graph_features", _GRAPH + ", c AS (SELECT src AS node, count(*) AS degree FROM b GROUP BY src) SELECT vec_id, degree, len(embedding) + 1 AS width FROM embeddings JOIN c ON node = vec_id")
def _(s, d):
    e = _emb(s, d)
    g = G.degrees(_near_graph(s, d), e.select(F.col("vec_id").alias("node")))
    x = e.join(g, F.col("vec_id") == F.col("node")).select("vec_id", "degree", F.concat(V.doubles(F.col("embedding")), F.array(F.col("degree").cast("double"))).alias("x"))
    return x.select("vec_id", "degree", F.size("x").cast("long").alias("width"))


@query("export_edge_list", "SELECT concat(n_name, chr(9), r_name) AS line FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return edge_lines(n.select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")), "tsv")


@query("relation_ids", _TREE + "SELECT concat('REL_', substr(md5(concat(child, '|', parent)), 1, 8)) AS ID, parent, child FROM l")
def _(s, d):
    return with_relation_ids(_tree(s, d))


@query("id_backfill", f"SELECT row_pos, coalesce(CAST(e.id AS VARCHAR), concat('MISSING_ID_', row_pos)) AS id FROM terms_train LEFT JOIN (SELECT {_K.format('text_description')} AS t, max(id) AS id FROM entities WHERE {_K.format('text_description')} <> '' GROUP BY 1) e ON e.t = {_K.format('term')}")
def _(s, d):
    t = table(s, d, "terms_train").withColumn("text", term_key(F.col("term")))
    return t.join(_names(s, d), "text", "left").select("row_pos", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("MISSING_ID_"), F.col("row_pos").cast("string"))).alias("id"))


@query("workload_estimate", "SELECT grp AS dataset, count(*) AS terms, count(*) * count(*) AS cells, count(*) > 1000 AS large FROM (SELECT CASE WHEN trim(coalesce(dataset, '')) = '' THEN 'default' ELSE lower(trim(dataset)) END AS grp FROM entities) GROUP BY grp")
def _(s, d):
    n = F.count("*")
    return _groups(s, d).groupBy(F.col("grp").alias("dataset")).agg(n.alias("terms"), (n * n).alias("cells"), (n > 1000).alias("large"))


@query("window_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return W.tumbling(e, "ts", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("session_events", "WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), k AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, k")
def _(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return W.sessions(e, "ts", "user_id").select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

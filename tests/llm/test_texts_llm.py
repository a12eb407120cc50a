"""Overlaps, copies, leaks, mixing and reading levels against brute force, with nulls, blanks, long texts, repeats and empty tables."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ontospark.llm import copies, leaks, mixing, overlaps, queries, reading

ENT = "id long, text_description string, split_name string, dataset string, sig string, key string, at string, n int"


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def entities(spark, rows):
    return spark.createDataFrame([(*r, "s", "k", "a", 1) for r in rows], ENT)


def test_overlaps_match_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.sample(vocab, rng.choice([1, 2, 3, 4, 5, 8, 12, 20, 35, 60, 64, 66, 90, 150])) for _ in range(120)]
    rows = []
    for i in range(500):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            if rng.random() < 0.5 and len(w) > 1:
                w.pop(rng.randrange(len(w)))
            else:
                w.insert(rng.randrange(len(w) + 1), rng.choice(vocab))
        rng.shuffle(w)
        rows.append((i, ", ".join(w + w[:1]).upper() if i % 3 else " ".join(w), rng.choice([" Train", "train", "test", "dev", None]), "d"))
    rows += [(900, None, "test", "d"), (901, "  ", "test", "d"), (902, "!!", "train", "d"), (903, "??", "test", "d"), (None, "w1", "train", "d")]
    df = entities(spark, rows + rows[:30])
    sets = [(r[0], (r[2] or "").strip().lower(), set(words(r[1] or ""))) for r in rows if r[0] is not None]
    want = {(min(a, b), max(a, b)) for a, s, x in sets for b, t, y in sets if s in ("test", "dev") and t == "train" and x and y and 10 * len(x & y) >= 8 * len(x | y)}
    assert {(r.id_a, r.id_b) for r in overlaps.overlap_pairs(df).collect()} == want and len(want) > 150
    report = overlaps.overlap_report(entities(spark, rows)).collect()
    assert sum(r.records for r in report) == sum(1 for _, s, x in sets if s in ("test", "dev") and x)
    assert overlaps.overlap_pairs(df.limit(0)).count() == 0


def test_very_long_overlap(spark):
    w = [f"x{i}" for i in range(3000)]
    df = entities(spark, [(1, " ".join(w), "train", "d"), (2, " ".join(w[:2500]), "test", "d"), (3, " ".join(w[:2300]), "dev", "d")])
    assert {(r.id_a, r.id_b) for r in overlaps.overlap_pairs(df).collect()} == {(1, 2)}


def test_copies(spark):
    rows = [(1, "Label: A-b; part of: C", "x", " D"), (2, "part of c|LABEL a b", "x", "d"), (3, "label ab\npartof  c", "x", "D "), (4, "label ab", "x", "d"), (5, "label ab; ; label ab", "x", "d"),
            (6, None, "x", "d"), (7, " \t", "x", "d"), (8, "...", "x", None), (9, "--", "x", "default"), (10, "label ab", "x", "other"), (None, "label ab", "x", "d")]
    rows += [(100 + i, "same text", "x", "d") for i in range(50)] + [(1, "Label: A-b; part of: C", "x", " D")]
    df = entities(spark, rows)
    got = {(r.keep_id, r.copy_id) for r in copies.copy_links(df).collect()}
    assert got == {(1, 2), (1, 3), (8, 9)} | {(100, 100 + i) for i in range(1, 50)}
    rec = {r.keep_id: (r.copies, r.variants) for r in copies.collapsed_records(df).collect()}
    assert rec[1] == (4, 3) and rec[100] == (50, 1) and rec[4] == (1, 1) and sum(c for c, _ in rec.values()) == 59
    assert copies.copy_links(df.limit(0)).count() == 0 == copies.collapsed_records(df.limit(0)).count()


DOCS = "doc_id long, text string, lang string, source string, item_id int, words string, w string"
ITEMS = "item_id long, item_text string, text string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS)


def brute_leaks(texts, items, least=8):
    grams = {}
    for i, t in items:
        w = words(t or "")
        for s in range(len(w) - least + 1):
            grams.setdefault(tuple(w[s : s + least]), set()).add(i)
    return {(d, i) for d, t in texts for w in [words(t or "")] for s in range(len(w) - least + 1) for i in grams.get(tuple(w[s : s + least]), ())}


@pytest.mark.parametrize("shard", [4 << 20, 300])
def test_leaks_match_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(leaks, "SHARD", shard)
    rng = random.Random(4)
    vocab = ["the", "of", "naïve", "straße", "x1"] + [f"v{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 8, 12, 30])))) for i in range(25)] + [(90, None), (91, ""), (92, items_text := "the of " * 12)]
    rows = []
    for d in range(120):
        w = rng.choices(vocab, k=rng.randrange(0, 60))
        src = words(rng.choice(items)[1] or "")
        a = rng.randrange(len(src) + 1)
        w[5:5] = src[a : a + rng.choice([5, 7, 8, 9, 30])]
        rows.append((d, ". ".join(w).upper() if d % 2 else " ".join(w), "en", "s"))
    rows += [(500, None, "en", "s"), (501, "", "en", "s"), (502, items_text, "en", "s"), (503, " ".join(vocab * 4000) + " " + items[3][1], "en", "s"), (None, items[3][1], "en", "s"), rows[0]]
    df, it = docs(spark, rows), spark.createDataFrame([(*i, "z") for i in items], ITEMS)
    found = leaks.leaked_passages(df, it, whole=False).collect()
    want = brute_leaks([(r[0], r[1]) for r in rows if r[0] is not None], items)
    assert {(r.doc_id, r.item_id) for r in found} == want and len(want) > 12
    text = {r[0]: words(r[1] or "") for r in rows}
    blocks = leaks.leaked_passages(df, it.withColumn("item_text", F.col("item_text")), whole=False)
    monkeypatch.setattr(leaks, "ITEM_BYTES", 600)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, leaks.leaked_passages(df, it, whole=False).collect()))
    for r in found[:200]:
        assert text[r.doc_id][r.doc_at : r.doc_at + r.words] == words(dict(items)[r.item_id])[r.item_at : r.item_at + r.words]
    longer = want | {(d, i) for d, w in text.items() if d is not None for i, t in items for x in [words(t or "")] if 0 < len(x) < 8 and any(w[s : s + len(x)] == x for s in range(len(w)))}
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_passages(df, it).collect()} == longer > want
    assert leaks.without_leaks(df, it).count() == len(rows) - sum(r[0] in {d for d, _ in longer} for r in rows)
    assert leaks.leaked_passages(df.limit(0), it).count() == 0 == leaks.leaked_passages(df, it.limit(0)).count()


TARGETS = "source string, target_share double, max_repeats int"


def test_mix(spark):
    rng = random.Random(6)
    size = {"big": 3000, "mid": 300, "tiny": 30}
    rows = [(n, f"{s} text number {n} " + "word " * rng.randrange(5, 40), "en", [s, s.upper(), f" {s} "][n % 3]) for n, s in enumerate(s for s, k in size.items() for _ in range(k))]
    rows += [(9000 + i, rows[0][1], "en", "big") for i in range(50)] + [(9100, None, "en", "big"), (9101, "", "en", "mid"), (None, "x", "en", "mid"), (9102, "no target", "en", "zzz"), (9103, "no source", "en", None)]
    goal = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 4), ("none", 0.0, 1)], TARGETS)
    mix = mixing.Mix(docs(spark, rows), goal)
    picks = mix.picks().collect()
    most = {"big": 1, "mid": 2, "tiny": 4}
    assert all(1 <= r.copies <= most[r.source] for r in picks) and len({r.doc_id for r in picks}) == len(picks)
    assert not {r.doc_id for r in picks} & set(range(9000, 9104))
    shares = {r.source: r for r in mix.shares().collect()}
    assert all(abs(shares[s].actual_share - g) < 0.03 for s, g in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2))) and shares["none"].used_docs == 0
    more = {r.source: r for r in mixing.Mix(docs(spark, rows), goal, total_tokens=1e6).shares().collect()}
    assert more["tiny"].used_docs == 30 and more["tiny"].most_copies == 4 and more["big"].most_copies == 1 and more["big"].used_docs == 3000
    assert mixing.Mix(docs(spark, rows).limit(0), goal).picks().count() == 0


def test_mix_in_runs_has_the_expected_count(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN_ROWS", 37)
    rows = [(n, f"text {n}", "en", "a" if n % 4 else "b") for n in range(800)]
    mix = mixing.Mix(docs(spark, rows), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], TARGETS))
    rate = {r.source: (r.rate, r.docs) for r in mix.plan.collect()}
    got = {}
    for r in mix.picks().collect():
        got[r.source] = got.get(r.source, 0) + r.copies
    assert all(abs(got[s] - rate * n) <= 1.001 for s, (rate, n) in rate.items())


EASY, HARD = "The cat is fat. It can run. We see a dog. ", "Comprehensive multidimensional characterisation presupposes electrochemical instrumentation whose intergenerational consequences practitioners nevertheless systematically underestimate throughout heterogeneous experimental configurations considering stoichiometric differentiation and sedimentation. "


def test_bands_need_no_levels(spark, monkeypatch):
    """Bands are the measures': no stage is run that can't change them, and the surrounding documents have no say."""
    monkeypatch.setattr(reading, "reading_levels", lambda *a, **k: pytest.fail("levels have no part in the bands"))
    easy, hard = "we go to the old mill now. " * 6, " ".join(["considerable"] * 25) + ". " + " ".join(["consequences"] * 25)
    rows = [(1, easy, "EN-gb"), (2, hard, " en"), (3, easy, "de"), (4, easy, None), (5, None, "en"), (6, "short one.", "en"), (1, easy, "en"), (None, easy, "en")]
    df = spark.createDataFrame(rows, "id long, body string, code string")
    got = [tuple(r) for r in reading.reading_bands(df, doc_id="id", text="body", lang="code").collect()]
    assert sorted(got) == [(1, "basic"), (2, "advanced")]


def test_reading(spark):
    rng = random.Random(8)
    middle = lambda n: " ".join(f"Most curators link the {rng.choice(['garden', 'village', 'record'])} to item {n} because both are mapped in the same table." for _ in range(4))
    rows = [(n, EASY * 4, "en", "s") for n in range(20)] + [(100 + n, HARD * 3, "EN-gb", "s") for n in range(20)] + [(200 + n, middle(n), "en", "s") for n in range(40)]
    rows += [(300, None, "en", "s"), (301, " .. ", "en", "s"), (302, EASY, "en", "s"), (303, EASY * 4, "de", "s"), (304, EASY * 4, None, "s"), (305, HARD * 3000, "en", "s"), (None, EASY, "en", "s"), (0, EASY * 4, "en", "s")]
    df = docs(spark, rows)
    level = {r.doc_id: r.level for r in reading.reading_levels(df).collect()}
    assert max(level[n] for n in range(20)) < min(level[200 + n] for n in range(40)) and max(level[200 + n] for n in range(40)) < min(level[100 + n] for n in range(20))
    assert set(level) == {r[0] for r in rows if r[0] is not None} - {300, 301}
    bands = {(r.doc_id, r.reading_band) for r in reading.reading_bands(df).collect()}
    assert bands == {(n, "basic") for n in range(20)} | {(100 + n, "advanced") for n in range(20)} | {(305, "advanced")}
    assert reading.reading_levels(df.limit(0)).count() == 0
    assert sum(r.docs for r in reading.reading_profile(df).collect()) == len(rows) - 3


def test_sentences(spark):
    text = ["One. Two!? Three", "e.g. this 3.5 is. . .", "a\nb.\nc", "no end", 'He said "go." Then', "x.y."]
    df = docs(spark, [(i, t, "en", "s") for i, t in enumerate(text)])
    want = [sum(1 for p in re.split(r"[.!?](?=\s|$)", t) if re.search(r"[^\W_]", p)) for t in text]
    assert [r.n_sentences for r in reading.text_measures(df).orderBy("doc_id").collect()] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "é", "x9"]), min_size=1, max_size=40))
def test_words_round_trip(ws):
    w = leaks.Words([" ".join(ws).encode(), b"", b"tail"])
    assert [w.piece(i, 1).decode() for i in range(len(ws))] == ws and len(set(w.hash.tolist())) == len({*ws, "tail"})


def test_every_query_is_registered():
    names = queries.queries()
    assert {f"p{n}_found" for n in (1, 3, 4, 5, 7, 9)} <= set(names) and set(queries.oracle_sql()) <= set(names)


def test_null_tokens(spark):
    df = docs(spark, [(1, "hello world", "en", "s"), (2, None, "en", "s"), (3, "", "en", "s")])
    assert [r.n for r in df.orderBy("doc_id").select(mixing.token_counts(F.col("text")).alias("n")).collect()] == [2, None, 0]


def test_levels_are_those_of_the_converged_model(spark):
    """Against the same model solved in NumPy by as many turns as it takes."""
    rng = np.random.default_rng(5)
    names = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 12))) for _ in range(70)]
    weight = 1 / np.arange(1, 71)
    texts = [sorted(set(rng.choice(names, rng.integers(8, 60), p=weight / weight.sum()))) for _ in range(1500)]
    vocabulary = sorted({w for t in texts for w in t})
    has = np.array([[w in t for w in vocabulary] for t in texts], float)
    docs = has.sum(0)
    own, size = docs >= reading.LEAST_DOCS, np.array([len(w) for w in vocabulary], float)
    rarity = -np.log(np.where(own, docs, reading.LEAST_DOCS) / len(texts))
    prior = (size - np.average(size[own], weights=docs[own])) / 3 + 0.15 * (rarity - np.average(rarity[own], weights=docs[own]))
    b, level = prior.copy(), np.zeros(len(texts))
    for _ in range(600):
        p = has / (1 + np.exp(b - level[:, None]))
        level += np.clip((reading.KNOWN * has.sum(1) - p.sum(1) - reading.HOLD_TEXT * level) / ((p * (1 - p)).sum(1) + reading.HOLD_TEXT), -1, 1)
        p = has / (1 + np.exp(b - level[:, None]))
        step = ((p - reading.KNOWN * has).sum(0) - reading.HOLD_WORD * (b - prior)) / ((p * (1 - p)).sum(0) + reading.HOLD_WORD)
        b += np.where(own, np.clip(step, -1, 1), 0)
    assert np.abs(step[own]).max() < 1e-5
    df = spark.createDataFrame([(i, " ".join(t), "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.level for r in reading.reading_levels(df).collect()}
    want = (level - level.mean()) / level.std()
    assert max(abs(got[i] - v) for i, v in enumerate(want)) < 0.005


def test_turns_without_an_end_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(reading, "MOST_TURNS", 1)
    df = spark.createDataFrame([(i, " ".join(["word", "other", "longerword"][: 1 + i % 3] * 3), "en") for i in range(12)], "doc_id long, text string, lang string")
    with pytest.raises(RuntimeError, match="still move"):
        reading.reading_levels(df)

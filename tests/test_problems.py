"""Orphan references and hierarchies against brute force, with nulls, blanks, repeats, loops, empty tables and clashing columns."""

import datetime as dt
import random

import numpy as np
import pytest

from ontospark.operators import hierarchy
from ontospark.operators import orphans as orphans_of
from ontospark.operators.components import connected_components
from ontospark.operators.hierarchy import Hierarchy, term_links
from ontospark.operators.orphans import and_not, compressed, orphan_references, orphan_report

T0 = dt.datetime(2020, 1, 1)
ENT = "id long, text_description string, added_at timestamp_ntz, deleted_at timestamp_ntz, side string, key long"
REL = "rel_id string, parent string, child string, added_at timestamp_ntz, loaded_at timestamp_ntz, at string"
PAIR = "pair_id long, parent_id long, child_id long, added_at timestamp_ntz, bit int"
TOP = "term string, added_at timestamp_ntz"


def day(n):
    return T0 + dt.timedelta(days=n)


def orphans(spark, ent, top, rel, pair):
    frames = [spark.createDataFrame(r, s) for r, s in ((ent, ENT), (top, TOP), (rel, REL), (pair, PAIR))]
    return orphan_references(*frames)


def test_orphans_match_brute_force(spark):
    rng = random.Random(3)
    ent = [(i, rng.choice([f"Term  {i % 37}", f"term {i % 37}\t", None, " "]), day(rng.randrange(0, 2500)) if i % 11 else None, day(rng.randrange(0, 3000)) if i % 3 == 0 else None, "x", 1) for i in range(300)]
    # references in every month of ten years, so that the last bit of a container is met too
    rel = [(f"r{i}", rng.choice([f"TERM {rng.randrange(45)}", "", None, "top"]), f"term {rng.randrange(45)}", day(rng.randrange(0, 3650)) if i % 50 else None, None, "q") for i in range(600)]
    rel += rel[:20]
    pair = [(i, rng.choice([None, rng.randrange(320)]), rng.randrange(320), day(rng.randrange(0, 3650)), 1) for i in range(300)]
    got = {(r.tbl, r.ref_key, r.side) for r in orphans(spark, ent, [("Top", day(100))], rel, pair).collect()}
    key = lambda s: " ".join(s.split()).lower() if s is not None else None
    spans = [(key(e[1]), e[0], e[2], e[3]) for e in ent if e[2]]
    want = set()
    for name, rows, pos in (("relations", rel, 0), ("relation_pairs", pair, 1)):
        for r in rows:
            for side, v in (("parent", r[1]), ("child", r[2])):
                v = key(v) if pos == 0 else v
                if v in (None, "") or r[3] is None:
                    continue
                have = any((s[pos] == v) and s[2] <= r[3] and (s[3] is None or r[3] < s[3]) for s in spans) or (pos == 0 and v == "top" and r[3] >= day(100))
                if not have:
                    want.add((name, str(r[0]), side))
    assert got == want and want


def test_orphans_edges(spark):
    at = dt.datetime(2021, 5, 31, 23, 59)
    ent = [(1, "a", at, at + dt.timedelta(days=1), "", 0)]
    pair = [(1, 1, None, at, 0), (2, 1, None, at + dt.timedelta(days=1), 0), (3, 1, None, at - dt.timedelta(microseconds=1), 0)]
    got = orphans(spark, ent, [], [], pair)
    assert sorted(r.ref_key for r in got.collect()) == ["2", "3"]
    assert [(r.month, r.orphans) for r in orphan_report(got).orderBy("month").collect()] == [("2021-05", 1), ("2021-06", 1)]
    assert orphans(spark, ent, [], [], []).count() == 0
    assert orphans(spark, [], [], [("r", "a", "b", at, None, "")], []).count() == 2


def tree(spark, rows, **options):
    return Hierarchy(spark.createDataFrame(rows, "child string, parent string"), **options)


def brute(par):
    out = {}
    for c in par:
        seen, x, d = {c}, c, 0
        while x in par:
            x, d = par[x], d + 1
            if x in seen:
                x, d = "(cycle)", -1
                break
            seen.add(x)
        out[c] = (x, d)
    return out


@pytest.mark.parametrize("task_nodes, last_nodes, shrink", [(1 << 20, 1 << 16, 0.7), (40, 30, 2.0), (7, 5, 0.0)])
def test_hierarchy_matches_brute_force(spark, monkeypatch, task_nodes, last_nodes, shrink):
    monkeypatch.setattr(hierarchy, "SHRINK", shrink)
    rng = random.Random(5)
    par = {f"n{i}": f"n{rng.randrange(max(1, i // 2), i)}" for i in range(2, 300)}
    par |= {f"deep{i}": f"deep{i - 1}" for i in range(1, 90)}
    par |= {"a": "b", "b": "c", "c": "a", "below": "a", "low": "below", "self": "self"} | {f"leaf{i}": "deep3" for i in range(50)}
    h = tree(spark, list(par.items()), task_nodes=task_nodes, last_nodes=last_nodes)
    want = brute(par)
    assert {r.node: (r.root, r.depth) for r in h.nodes().collect()} == want
    assert {r.node for r in h.loops().collect()} == {"a", "b", "c", "self"}
    paths = {r.node: (r.path, r.depth) for r in h.paths().collect()}
    assert set(paths) == {c for c, (r, _) in want.items() if r != "(cycle)"}
    for c, (p, d) in paths.items():
        assert p[0] == want[c][0] and p[-1] == c and len(p) == d + 1 == want[c][1] + 1
        assert all(par[b] == a for a, b in zip(p, p[1:]))
    assert h.descendants().count() == sum(d for _, d in want.values() if d > 0)


def test_links_and_empty(spark):
    at = dt.datetime(2020, 1, 1)
    rows = [("r1", " P ", "c\t1", at, at), ("r1", "P", "C 1", at, at), ("r2", "q", "c 1", at + dt.timedelta(1), at), ("r3", None, "x", at, at), ("r4", "y", "  ", at, at), ("r5", "late", "d", None, at), ("r6", "soon", "d", at, at)]
    df = spark.createDataFrame(rows, "rel_id string, parent string, child string, added_at timestamp, p timestamp")
    assert {(r.child, r.parent) for r in term_links(df).collect()} == {("c 1", "p"), ("d", "soon")}
    h = tree(spark, [])
    assert h.nodes().count() == h.loops().count() == h.paths().count() == h.descendants().count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 6), (9, 9), (None, 1), (7, None)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 260)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 9: 9} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 261)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_containers():
    rng = np.random.default_rng(1)
    for size in (10, 5000, 65536):
        for a, b in ((0.001, 0.9), (0.9, 0.001), (0.9, 0.9), (0.001, 0.001), (0.0, 1.0), (1.0, 0.0)):
            one, two = rng.random(size) < a, rng.random(size) < b
            assert and_not(compressed(one), compressed(two)).tolist() == np.flatnonzero(one & ~two).tolist()


def test_hot_references_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(orphans_of, "HOT_ROWS", 20), monkeypatch.setattr(orphans_of, "RANGE_ROWS", 8)
    live = [(i, f"t{i % 4}", day(5 * i), day(5 * i + 9) if i % 3 else None, "", 0) for i in range(1, 40)] + [(90, "short", day(3), day(5), "", 0), (91, "short", day(10), day(11), "", 0)]
    refs = [(f"r{i}", "t1" if i % 3 else "short", f"t{i % 6}", day(i % 200), None, "") for i in range(400)]
    got = {(r.ref_key, r.side) for r in orphans(spark, live, [], refs, []).collect()}
    want = {(r[0], side) for r in refs for side, t in (("parent", r[1]), ("child", r[2])) if not any(e[1] == t and e[2] <= r[3] and (e[3] is None or r[3] < e[3]) for e in live)}
    assert got == want and want


def test_one_group_is_bounded():
    assert hierarchy.TASK_NODES * 24 < 64 << 20

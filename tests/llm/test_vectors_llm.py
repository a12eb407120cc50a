"""Neighbours and clusters against brute force; unusable vectors, copies, hot groups, ties, empty tables, clashing columns."""

import numpy as np
import pytest

from ontospark.llm import clusters, neighbours
from ontospark.llm.vectors import AnisotropicCodes, from_nibbles, link_between, link_rows, nibbles, pack, unpack

SCHEMA = "id long, embedding array<float>, dataset string, cell int, grp string, vec string, lead string"


def blobs(seed=0, sizes=(60, 30, 9, 5, 4, 3), noise=120, dim=128):
    rng = np.random.default_rng(seed)
    x, who = [], []
    for n, size in enumerate(sizes):
        c = rng.standard_normal(dim)
        c /= np.linalg.norm(c)
        for _ in range(size):
            x.append(c + rng.standard_normal(dim) * 0.38 / np.sqrt(dim))
            who.append(n)
    for _ in range(noise):
        x.append(rng.standard_normal(dim))
        who.append(-1)
    x = np.array(x)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x.astype(np.float32), np.array(who)


def frame(spark, x, groups, first=1):
    rows = [(first + i, v.tolist(), g, 1, "g", "v", "l") for i, (v, g) in enumerate(zip(x, groups))]
    bad = [(90_001, [], "a"), (90_002, [0.0] * 128, "a"), (90_003, [float("nan")] * 128, "a"), (90_004, [1.0] * 64, "a"), (90_005, None, "a"), (None, [1.0] * 128, "a"), (90_006, [0.0] * 128, "a"), (90_007, [None] + [1.0] * 127, "a")]
    return spark.createDataFrame(rows + [(*b, 1, "g", "v", "l") for b in bad], SCHEMA)


def test_clusters_match_brute_force(spark):
    x, who = blobs()
    x = x * np.where(np.arange(len(x)) % 9 == 0, 7.5, 1.0)[:, None].astype(np.float32)
    groups = [[" A", "a", "A "][i % 3] if w != 1 else (None if i % 2 else "") for i, w in enumerate(who)]
    df = frame(spark, x, groups)
    got = {r.id: r.cluster_id for r in clusters.cluster_members(df).collect()}
    want = {}
    for n in range(4):
        ids = (np.flatnonzero(who == n) + 1).tolist()
        want |= dict.fromkeys(ids, ids[0])
    assert got == want
    report = {r.cluster_id: r for r in clusters.cluster_report(df).collect()}
    assert {k: r.n for k, r in report.items()} == {1: 60, 61: 30, 91: 9, 100: 5}
    assert report[61].dataset == "default" and all(set(r.typical) <= {i for i, c in got.items() if c == k} for k, r in report.items())


def test_clusters_of_copies_salts_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(clusters, "STRIP", 40), monkeypatch.setattr(clusters, "CELL", 80)
    x, _ = blobs(noise=20)
    same = np.repeat(x[:1], 150, axis=0)
    df = frame(spark, np.concatenate([same, x[1:60]]), ["a"] * 209)
    got = clusters.cluster_members(df.union(df)).collect()
    assert {r.cluster_id for r in got} == {1} and {r.id for r in got} == set(range(1, 210))
    assert clusters.cluster_members(df.limit(0)).count() == 0
    assert clusters.cluster_report(df.limit(0)).count() == 0


def test_links_are_components():
    x = np.eye(4, dtype=np.float32)
    chain = np.array([x[0], (x[0] + x[1]) / np.sqrt(2), x[1], x[3]], np.float32)
    assert link_rows(chain, np.arange(4), 0.7).tolist() == [0, 0, 0, 3]
    assert link_rows(chain, np.array([5, 6, 7, 7]), 0.7).tolist() == [0, 0, 0, 0]  # the last two are known to be one group


def test_rows_alike_to_two_groups_join_them():
    turn = lambda degrees: [np.cos(np.radians(degrees)), np.sin(np.radians(degrees))]
    x = np.array([turn(d) for d in (0, 80, 40, 110)])
    # 0 and 80 degrees are no alike pair; the third row, in a later block, is alike to both, the fourth to the second alone
    assert link_rows(x, np.arange(4), 0.7, block=2).tolist() == [0, 0, 0, 0]
    assert link_rows(x, np.arange(4), 0.7, split=2).tolist() == [0, 0, 0, 0]
    assert link_rows(x[[0, 1, 3]], np.arange(3), 0.7).tolist() == [0, 1, 1]
    assert link_rows(x[[0, 1, 3]], np.arange(3), 0.7, split=1).tolist() == [0, 1, 2]


@pytest.mark.parametrize("axes", [1, 2])
def test_grids_see_pairs_at_the_threshold(axes):
    """The share of single pairs at cosine 0.70 that lie in one cell of some grid."""
    rng = np.random.default_rng(9)
    a, step = rng.standard_normal((2, 3000, 128))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    step -= (step * a).sum(1, keepdims=True) * a
    b = 0.70 * a + np.sqrt(1 - 0.49) * step / np.linalg.norm(step, axis=1, keepdims=True)
    seen = np.zeros(len(a), bool)
    for turn in range(clusters.TURNS[axes]):
        one, two = (clusters._cells(x.astype(np.float32), turn, axes, 128, 11)[1].reshape(len(a), -1) for x in (a, b))
        seen |= (one[:, :, None] == two[:, None, :]).any((1, 2))
    assert seen.mean() >= 0.99


@pytest.mark.parametrize("rows, cell", [(1 << 15, 1 << 17), (40, 160), (17, 34)])
def test_chains_stay_whole(spark, monkeypatch, rows, cell):
    """Clusters that only a chain of pairs near the threshold holds together, over one strip and over many."""
    monkeypatch.setattr(clusters, "STRIP", rows), monkeypatch.setattr(clusters, "CELL", cell)
    rng, at, x = np.random.default_rng(4), [], []
    for chain in range(6):
        v = rng.standard_normal(128)
        v /= np.linalg.norm(v)
        for _ in range(25):
            x.append(v)
            at.append(chain)
            step = rng.standard_normal(128)
            step -= (step @ v) * v
            v = 0.705 * v + np.sqrt(1 - 0.705**2) * step / np.linalg.norm(step)
    order = rng.permutation(len(x))
    x, at = np.array(x, np.float32)[order], np.array(at)[order]
    first = {c: int(np.flatnonzero(at == c)[0]) + 1 for c in range(6)}
    got = {r.id: r.cluster_id for r in clusters.cluster_members(frame(spark, x, ["a"] * len(x))).collect()}
    want = {i + 1: first[c] for i, c in enumerate(at)}
    if cell > len(x):
        assert got == want
    else:  # a lost link breaks a chain; nothing joins two
        assert sum(got.get(i) == c for i, c in want.items()) >= 0.9 * len(want)
        assert all({at[i - 1] for i, c in got.items() if c == k} == {at[k - 1]} for k in set(got.values()))


@pytest.mark.parametrize("strip, cell, chunk", [(1 << 15, 1 << 17, 1 << 16), (60, 120, 1 << 16), (25, 50, 40)])
def test_clusters_do_not_depend_on_the_cell_bound(spark, monkeypatch, strip, cell, chunk):
    """Loose chains near the threshold, dense groups, pairs of these that one row joins, and copies: exact whatever fits into one cell."""
    monkeypatch.setattr(clusters, "STRIP", strip), monkeypatch.setattr(clusters, "CELL", cell), monkeypatch.setattr(clusters, "CHUNK", chunk)
    rng = np.random.default_rng(12)
    x = [v for v in blobs(7, sizes=(60, 40, 20, 9), noise=60)[0]]
    for start in (x[0], x[60], rng.standard_normal(128), rng.standard_normal(128), rng.standard_normal(128)):
        v = start / np.linalg.norm(start)
        for _ in range(30):  # each row is alike to the one before it only
            step = rng.standard_normal(128)
            step -= (step @ v) * v
            v = 0.7005 * v + np.sqrt(1 - 0.7005**2) * step / np.linalg.norm(step)
            x.append(v)
    x = np.array(x, np.float32)
    order = rng.permutation(len(x))
    x = np.concatenate([x[order], x[order[:25]]])
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    low = np.arange(len(u))
    while ((new := np.where(u @ u.T >= 0.7, low, len(u)).min(1)) != low).any():
        low = new
    size = np.bincount(low, minlength=len(u))[low]
    want = {i + 1: int(k) + 1 for i, k in enumerate(low) if size[i] >= 5}
    got = {r.id: r.cluster_id for r in clusters.cluster_members(frame(spark, x, ["a"] * len(x))).collect()}
    assert got == want and len(set(want.values())) >= 5


def test_dense_groups_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Groups whose rows lie 26 degrees from their mean, and groups of five: balls hold nearly all their rows, the rest is noise."""
    monkeypatch.setattr(clusters, "STRIP", 60), monkeypatch.setattr(clusters, "CELL", 120)
    loose, links = [], clusters._loose_links

    def spy(rows, *args):
        loose.append((rows.filter("not held") if "held" in rows.columns else rows).count())
        return links(rows, *args)

    monkeypatch.setattr(clusters, "_loose_links", spy)
    rng, x, want = np.random.default_rng(21), [], {}
    for size in [60] * 6 + [5] * 6:
        c = rng.standard_normal(128)
        c /= np.linalg.norm(c)
        first = len(x) + 1
        for _ in range(size):
            step = rng.standard_normal(128)
            step -= (step @ c) * c
            x.append(np.cos(np.radians(26)) * c + np.sin(np.radians(26)) * step / np.linalg.norm(step))
            want[len(x)] = first
    x += list(rng.standard_normal((40, 128)))
    got = {r.id: r.cluster_id for r in clusters.cluster_members(frame(spark, np.array(x, np.float32), ["a"] * len(x))).collect()}
    assert got == want and loose[0] <= 40 + 0.2 * len(want)


def test_repeated_tables_are_compared_once(spark, monkeypatch):
    """A table repeated under other ids: what is dealt to the cells is as much as without the repeats, and all copies come out."""
    seen, spread = [], clusters._spread
    monkeypatch.setattr(clusters, "_spread", lambda copies, rows, *keys: seen.append(rows) or spread(copies, rows, *keys))
    x = blobs(3, sizes=(12, 5), noise=10)[0]
    got = {r.id: r.cluster_id for r in clusters.cluster_members(frame(spark, np.tile(x, (4, 1)), ["a"] * 4 * len(x))).collect()}
    own = {i: 1 if i <= 12 else 13 for i in range(1, 18)}
    assert {i: c for i, c in got.items() if (i - 1) % len(x) < 17} == {i + k * len(x): c for i, c in own.items() for k in range(4)}
    assert seen == [len(x)]


def test_links_between_two_sets():
    turn = lambda degrees: [np.cos(np.radians(degrees)), np.sin(np.radians(degrees))]
    x, y = (np.array([turn(d) for d in part], np.float32) for part in ((0, 80, 200), (40, 260, 110)))
    one, two = link_between(x, np.array([7, 8, 9]), y, np.array([4, 5, 6]), 0.7)
    assert sorted(zip(one.tolist(), two.tolist())) == [(6, 4), (7, 4), (8, 4)]
    assert not len(link_between(x[2:], np.array([9]), y, np.array([9, 9, 9]), 0.7)[0])


@pytest.mark.parametrize("degrees, length", [(20, 8), (30, 8), (40, 6)])
def test_chains_in_a_plane(spark, degrees, length):
    rng, x, groups = np.random.default_rng(degrees), [], []
    for n in range(40):
        plane = np.linalg.qr(rng.standard_normal((128, 2)))[0]
        for k in range(length):
            x.append(plane @ [np.cos(np.radians(degrees * k)), np.sin(np.radians(degrees * k))])
            groups.append(f"g{n}")
    got = {r.id: r.cluster_id for r in clusters.cluster_members(frame(spark, np.array(x, np.float32), groups)).collect()}
    assert got == {i + 1: i // length * length + 1 for i in range(len(x))}


def brute_pairs(x, k=5, least=0.96):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        for j in np.lexsort((np.arange(len(x)), -s[i]))[:k]:
            if s[i, j] >= least:
                out.add((min(i, j) + 1, max(i, j) + 1))
    return out


def near_copies(seed=1, n=150):
    x, _ = blobs(seed, sizes=(200, 40), noise=n)
    rng = np.random.default_rng(seed)
    y = x[::2] + rng.standard_normal(x[::2].shape) * 0.15 / np.sqrt(128)
    return np.concatenate([x, y]).astype(np.float32)


def test_pairs_match_brute_force(spark):
    x = near_copies()
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(frame(spark, x * np.float32(3), ["a"] * len(x))).collect()}
    want = brute_pairs(x.astype(np.float64))
    assert got <= want and len(got & want) >= 0.97 * len(want) > 100


def test_groups_of_copies(spark):
    x = near_copies(2, 40)
    x = np.concatenate([np.repeat(x[:1], 40, axis=0), x[1:], x[3:4], x[3:4]])
    lists = neighbours.near_neighbours(frame(spark, x, ["a"] * len(x)).union(frame(spark, x, ["a"] * len(x)))).collect()
    own = {}
    for r in lists:
        own.setdefault(r.id, []).append((r["rank"], r.near))
    assert [n for _, n in sorted(own[40])] == [1, 2, 3, 4, 5] and [n for _, n in sorted(own[3])] == [1, 2, 4, 5, 6]
    assert {n for _, n in own[43]} >= {len(x) - 1, len(x)}  # the two copies at the end of the table
    assert all(i != n for i, v in own.items() for _, n in v)


def test_small_and_empty_tables(spark):
    df = frame(spark, blobs()[0][:1], ["a"])
    assert neighbours.similar_pairs(df).count() == 0
    assert neighbours.similar_pairs(df.limit(0)).count() == 0
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_search_recall(spark):
    x = near_copies(3, 400)
    r = neighbours.nearest(frame(spark, x, ["a"] * len(x)), "id % 20 = 0", k=10).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    asked = [i for i in range(len(x)) if (i + 1) % 20 == 0]
    got = {}
    for row in r:
        got.setdefault(row.id, set()).add(row.near)
    hits = [len(got[i + 1] & {int(j) + 1 for j in np.argsort(-s[i])[:10]}) / 10 for i in asked]
    assert np.mean(hits) >= 0.9 and set(got) == {i + 1 for i in asked}


def test_codes():
    x, _ = blobs(5)
    base = np.zeros_like(x)
    c = AnisotropicCodes().fit(x, base)
    codes = c.encode(x, base)
    assert (from_nibbles(nibbles(codes)) == codes).all()
    t = c.tables(x[:7])
    assert np.allclose(c.scan(t, codes), c.decode(codes) @ x[:7].T, atol=1e-4)
    b, scale = c.byte_tables(x[:7])
    assert np.allclose(c.scan(b, nibbles(codes)) / scale, c.decode(codes) @ x[:7].T, atol=5e-3)
    plain = AnisotropicCodes(threshold=0.0).fit(x, base)
    error = lambda k: np.abs(((x - k.decode(k.encode(x, base))) * x).sum(1)).mean()
    assert error(c) < error(plain)


@pytest.mark.parametrize("scale", [1.0, 0.1])
def test_pack_is_lossless(scale):
    x = (np.arange(256).reshape(2, 128) * scale).astype(np.float32)
    assert (unpack(pack(x), 128) == x).all()


def test_full_cells_are_divided(spark, monkeypatch):
    """A dense cone that holds most rows, each with a twin, its cells divided before the shuffle: twins still meet."""
    monkeypatch.setattr(neighbours, "FULL", 100)
    rng = np.random.default_rng(8)
    cone = rng.standard_normal(128) / np.sqrt(128) + rng.standard_normal((200, 128)) * 0.16 / np.sqrt(128)
    twins = cone + rng.standard_normal(cone.shape) * 0.02 / np.sqrt(128)
    x = np.concatenate([cone, twins, rng.standard_normal((60, 128))]).astype(np.float32)
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(frame(spark, x, ["a"] * len(x))).collect()}
    assert sum((i, i + 200) in got for i in range(1, 201)) >= 190
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(u[a - 1] @ u[b - 1] >= 0.96 - 1e-6 for a, b in got)


def test_dense_cone(spark, monkeypatch):
    """All pairs of 1,200 rows are over the threshold: lists are cut on the way, and still the nearest are found."""
    monkeypatch.setattr(neighbours, "HELD", 5000)
    rng = np.random.default_rng(3)
    x = (rng.standard_normal(128) / np.sqrt(128) + rng.standard_normal((1200, 128)) * 0.16 / np.sqrt(128)).astype(np.float32)
    lists = neighbours.near_neighbours(frame(spark, x, ["a"] * len(x))).collect()
    got = {(r.id, r.near) for r in lists}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i + 1, int(j) + 1) for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    assert len(lists) == 5 * len(x) and len(got & want) >= 0.98 * len(want)

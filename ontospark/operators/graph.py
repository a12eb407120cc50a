"""Graph operators: term graph, degrees, clustering, PageRank, roles, cycles, depth, statistics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontospark.operators.components import connected_components
from ontospark.operators.hierarchy import Hierarchy
from ontospark.runtime import Stash


def term_graph(links: DataFrame) -> DataFrame:
    """``(src, dst, weight)`` from ``(a, b, a_types, b_types)``: undirected, weight = number of common types, 0.1 if none; of repeated
    edges the one from the larger (a, b) counts."""
    common = F.size(F.array_intersect("a_types", "b_types"))
    w = F.when(common > 0, common.cast("double")).otherwise(0.1)
    e = links.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.struct("a", "b").alias("order"), w.alias("w"))
    return e.groupBy("src", "dst").agg(F.max_by("w", "order").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, degree, centrality)``; a self-loop counts twice, nodes without an edge 0."""
    d = both_ways(edges).groupBy("src").count()
    n = nodes.count()
    deg = F.coalesce("count", F.lit(0))
    return nodes.join(d, F.col("node") == F.col("src"), "left").select("node", deg.alias("degree"), (deg / float(max(1, n - 1))).alias("centrality"))


def clustering(edges: DataFrame) -> DataFrame:
    """``(node, coefficient)`` of nodes with an edge; fewer than two neighbours give 0. Each triangle is found once, from its
    lowest-degree corner, so hubs do not square."""
    e = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    deg = e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    da, db = deg.select(F.col("node").alias("a"), F.col("d").alias("da")), deg.select(F.col("node").alias("b"), F.col("d").alias("db"))
    o = e.join(da, "a").join(db, "b")
    first = F.expr("da < db or (da = db and a < b)")
    up = o.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedge = up.alias("p").join(up.alias("q"), F.expr("p.x = q.x and p.y < q.y")).select(F.col("p.x").alias("x"), F.col("p.y").alias("a"), F.col("q.y").alias("b"))
    tri = wedge.join(e, ["a", "b"])
    t = tri.select(F.explode(F.array("x", "a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    c = F.when(F.col("d") < 2, 0.0).otherwise(2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.greatest("d", F.lit(2)) - 1)))
    return deg.join(t, "node", "left").select("node", c.alias("coefficient"))


def pagerank(edges: DataFrame, nodes: DataFrame, alpha: float = 0.85, rounds: int | None = None, tol: float = 1e-6, most: int = 100) -> DataFrame:
    """``(node, rank)`` over undirected weighted edges; nodes without an edge spread evenly. Rounds end when the ranks moved by less
    than ``tol`` a node in sum, as in networkx; not to get there in ``most`` is an error. ``rounds`` asks for a fixed number instead.
    Each round is written to the shared folder."""
    spark = edges.sparkSession
    stash = Stash(spark, "pagerank")
    both = edges.select("src", "dst", "weight").unionByName(edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = both.groupBy("src").agg(F.sum("weight").alias("total"))
    flow = stash.put(both.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    n = nodes.count()
    rank = stash.put(nodes.select("node", F.lit(1.0 / max(1, n)).alias("rank")))
    for _ in range(most if rounds is None else rounds):
        moved = flow.join(rank, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        kept = moved.agg(F.sum("got")).first()[0] or 0.0
        now = (alpha * (F.coalesce("got", F.lit(0.0)) + (1.0 - kept) / n) + (1 - alpha) / n) if n else F.lit(0.0)
        new = stash.put(rank.join(moved, F.col("node") == F.col("dst"), "left").select("node", now.alias("rank"), F.abs(now - F.col("rank")).alias("step")))
        step = new.agg(F.sum("step")).first()[0] or 0.0
        stash.drop(rank)
        rank = new
        if rounds is None and (not n or step < n * tol):
            break
    else:
        if rounds is None:
            raise RuntimeError(f"ranks still move by {step:.3g} in sum after {most} rounds")
    return rank.select("node", "rank")


def roles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, role)`` over child -> parent edges: root, leaf, intermediate or isolated."""
    c, p = edges.select(F.col("child").alias("node"), F.lit(1).alias("c")).distinct(), edges.select(F.col("parent").alias("node"), F.lit(1).alias("p")).distinct()
    role = F.when(F.expr("c = 1 and p = 1"), "intermediate").when(F.col("c") == 1, "leaf").when(F.col("p") == 1, "root").otherwise("isolated")
    return nodes.join(c, "node", "left").join(p, "node", "left").select("node", role.alias("role"))


def short_cycles(edges: DataFrame, longest: int = 3) -> DataFrame:
    """``(cycle)``: simple directed cycles of up to ``longest`` nodes, each once, from its smallest node."""
    e = edges.select(F.col("child").alias("s"), F.col("parent").alias("t")).distinct()
    walk = e.select(F.array("s").alias("path"), F.col("t").alias("end"))
    found = walk.filter("end = path[0]").select(F.col("path").alias("cycle"))
    for _ in range(longest - 1):
        walk = walk.filter("end > path[0] and not array_contains(path, end)").join(e, F.col("end") == F.col("s")).select(F.concat("path", F.array("s")).alias("path"), F.col("t").alias("end"))
        found = found.unionByName(walk.filter("end = path[0]").select(F.col("path").alias("cycle")))
    return found


_CYCLE = pa.schema([("cycle", pa.list_(pa.string()))])


def _walk(t: pa.Table) -> pa.Table:
    up = dict(zip(t.column("node").to_pylist(), t.column("parent").to_pylist()))
    path = [min(up, key=lambda x: x.encode())]
    while up[path[-1]] != path[0]:
        path.append(up[path[-1]])
    return pa.table([[path]], schema=_CYCLE)


def all_cycles(links: DataFrame) -> DataFrame:
    """``(cycle)``: every loop of ``(child, parent)`` links with one parent per child, of any length, from its smallest node. With one
    parent each, loops share no node, so all of them are no longer than the links; one loop is walked in one task."""
    on = Stash(links.sparkSession, "cycles").put(Hierarchy(links).loops())
    parts = connected_components(on, "node", "parent")
    return on.join(parts, "node").select("component", "node", "parent").groupBy("component").applyInArrow(_walk, "cycle array<string>")


def component_stats(components: DataFrame) -> DataFrame:
    """``(components, nodes, largest, mean_size)``."""
    return components.groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.sum("n").alias("nodes"), F.max("n").alias("largest"), F.avg("n").alias("mean_size"))


def max_depth(links: DataFrame, compat: bool = False) -> DataFrame:
    """``(max_depth)``: links from the deepest node up to its root, loops apart (G7); no links give 0. ``compat`` gives 0 always, as a walk
    from the roots along child -> parent edges, which no root has."""
    deep = F.lit(0).cast("long") if compat else F.greatest(F.coalesce(F.max("depth"), F.lit(0)), F.lit(0)).cast("long")
    return Hierarchy(links).nodes().agg(deep.alias("max_depth"))


def degree_counts(links: DataFrame) -> DataFrame:
    """``(term, children, parents)``: how many children and parents each term has."""
    c = links.groupBy(F.col("parent").alias("term")).agg(F.count("*").alias("children"))
    p = links.groupBy(F.col("child").alias("term")).agg(F.count("*").alias("parents"))
    return c.join(p, "term", "full").fillna(0)


def structure_report(links: DataFrame, terms: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """One row on a hierarchy of ``links (child, parent)`` over ``terms (node)``: node classes, density, components and depth (X14, A20-A22,
    G7). A term in no link is isolated and a component of its own. ``tree`` has the links that depth goes along, one parent each, where ``links``
    have more."""
    n = roles(links, terms).agg(F.count("*").alias("terms"), *[F.count_if(F.col("role") == r).alias(r) for r in ("root", "leaf", "intermediate", "isolated")])
    e = links.agg(F.count("*").alias("links"), F.count_distinct("parent").alias("parents"), F.count_distinct("child").alias("children"))
    c = component_stats(connected_components(links.unionByName(terms.select(F.col("node").alias("child"), F.col("node").alias("parent"))), "child", "parent")).select("components", "largest", "mean_size")
    row = n.join(F.broadcast(e)).join(F.broadcast(c)).join(F.broadcast(max_depth(links if tree is None else tree)))
    return row.withColumn("density", F.coalesce(F.try_divide("links", F.col("terms") * (F.col("terms") - 1.0)), F.lit(0.0)))

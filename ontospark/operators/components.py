"""Connected components of an undirected edge table (G5): forests of each partition's edges, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontospark.runtime import Stash


#: Edges that a task joins at once.
PART = 1 << 20


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``(u, v)`` as stars: of each part of the edges one link per node, from it to the smallest of its component there. Self-loops
    stay."""
    parts, n = [], 0
    for b in batches:
        if b.num_rows:
            parts.append(b)
            n += b.num_rows
        if n >= PART:
            yield _star(parts)
            parts, n = [], 0
    if parts:
        yield _star(parts)


def _star(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(parts)
    u, v = (t.column(k).to_numpy() for k in (0, 1))
    names, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    root = np.arange(len(names))
    while len(a):
        ra, rb = root[a], root[b]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    moved = np.flatnonzero(root != np.arange(len(names)))
    same = code[: len(u)] == code[len(u) :]
    loops = np.unique(code[: len(u)][same])
    low, high = np.concatenate([moved, loops]), np.concatenate([root[moved], loops])
    return pa.RecordBatch.from_arrays([pa.array(names[low], t.schema.field(0).type), pa.array(names[high], t.schema.field(1).type)], schema=t.schema)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.withColumnRenamed("m", "v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)``: the smallest node of each component, for every node of an edge.

    Each task first joins the edges it reads, so that dense parts leave one link per node. Each step then attaches all neighbours of a
    node to the smallest one, so labels travel in doubling strides and the edges end as stars round the minima. Null ends are ignored; a
    self-loop makes its node a component of its own; no edges give no rows. Steps are written to the shared folder and superseded ones
    removed.
    """
    stash = Stash(edges.sparkSession, "components")
    clean = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = stash.put(clean.mapInArrow(_stars, clean.schema).distinct())
    alone = now.filter("u = v").select(F.col("u").alias("node"))
    links, last = now.filter("u <> v"), None
    mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while mark[0] and mark != last:
        step = stash.put(_small_star(_large_star(links)))
        if last is not None:
            stash.drop(links)
        links, last = step, mark
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    linked = members.unionByName(roots)
    return linked.unionByName(alone.join(linked, "node", "left_anti").select("node", F.col("node").alias("component")))

"""Problem 6: parent-child links to full hierarchies with weighted disjoint-set forests.

Nodes are encoded as 64-bit hashes, which a second hash has shown free of collisions before use. Only nodes that have both a parent and a child need a
forest; leaves look their parent up at the end. The forest is a table ``(c, top, off, loop)``: from ``c`` it is ``off`` links up to
``top``. Links are dealt into groups and compressed inside one task each (unions with root offsets). Groups are merged level by level: only
nodes at which entries of other groups end go up, are dealt into fewer groups and compressed again, until one small group is left that finds
roots and loops; then each level looks its tops up in the one above. Where a level hardly shrinks (long bare chains), joins double the links
covered instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontospark.functions.text import term_key
from ontospark.runtime import Stash, checked_broadcast

#: Inner nodes that one task compresses (24 bytes each), and those that make up the last group.
TASK_NODES, LAST_NODES = 1 << 20, 1 << 16
#: Groups of a level at least, and the share of its nodes that may go up.
GROUPS, SHRINK = 16, 0.7
CYCLE = "(cycle)"

_FOREST = pa.schema([("c", pa.int64()), ("top", pa.int64()), ("off", pa.int64()), ("loop", pa.bool_())])


def _compress(t: pa.Table) -> pa.Table:
    """Weighted unions of one group: each node points past all nodes of the group, with the number of links in between."""
    t = t.combine_chunks().sort_by("c")
    c, top, off = (t.column(n).to_numpy().copy() for n in ("c", "top", "off"))
    loop = t.column("loop").to_numpy(zero_copy_only=False).copy()
    for _ in range(2 + max(1, len(c)).bit_length()):
        at = np.minimum(np.searchsorted(c, top), len(c) - 1)
        inside = (c[at] == top) & ~loop
        if not inside.any():
            break
        top, off = np.where(inside, top[at], top), np.where(inside, off + off[at], off)
        loop |= inside & loop[at]
        # longer than the number of nodes: the walk has gone round
        loop |= off > (1 << 62) // 2
    at = np.minimum(np.searchsorted(c, top), len(c) - 1)
    loop |= c[at] == top
    return pa.table([pa.array(c), pa.array(top), pa.array(np.where(loop, 0, off)), pa.array(loop)], schema=_FOREST)


def term_links(df: DataFrame, child: str = "child", parent: str = "parent", order: tuple[str, ...] = ("added_at", "rel_id")) -> DataFrame:
    """``(child, parent)``, one row per child: texts in compared form, both ends not blank; of several parents the first by ``order``,
    then by text."""
    first = F.struct(*[F.col(o).isNull().alias(f"n{i}") if j == 0 else F.col(o).alias(f"o{i}") for i, o in enumerate(order) for j in (0, 1)], F.col("p"))
    clean = df.select(term_key(F.col(child)).alias("c"), term_key(F.col(parent)).alias("p"), *[F.col(o) for o in order]).filter("c <> '' and p <> ''")
    return clean.groupBy(F.col("c").alias("child")).agg(F.min_by("p", first).alias("parent"))


def _encoder(links: DataFrame):
    """A hash under which no two texts share a code, as a second, independent hash tells."""
    nodes = links.select(F.explode(F.array("child", "parent")).alias("t"))
    for seed in range(42, 58):
        code = lambda text, s=seed: F.xxhash64(text, F.lit(s))
        by = nodes.groupBy(code(F.col("t")).alias("k")).agg(F.min(F.xxhash64(F.lit(seed), "t")).alias("a"), F.max(F.xxhash64(F.lit(seed), "t")).alias("b"))
        if by.filter("a <> b").limit(1).count() == 0:
            return code
    raise RuntimeError("no hash seed without collisions")


def _continued(forest: DataFrame, above: DataFrame) -> DataFrame:
    """Each entry followed on by the one that ``above`` has for its top."""
    up = above.select(F.col("c").alias("n"), F.col("top").alias("up"), F.col("off").alias("more"), F.col("loop").alias("round"))
    step = forest.join(up, (F.col("top") == F.col("n")) & ~F.col("loop"), "left")
    return step.select("c", F.coalesce("up", "top").alias("top"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"), (F.col("loop") | F.coalesce("round", F.lit(False))).alias("loop"))


class Hierarchy:
    """Roots, depths, paths and descendants over ``(child, parent)`` links with one parent per child.

    A node that is nobody's child is a root. Nodes on a loop (a self-link is one) or below one have root ``(cycle)`` and depth -1 and
    no path. Null ends must be removed before (:func:`term_links` does); no links give no rows. A parent with a third of all links is
    an ordinary row here: links meet it in a join, never in a group.
    """

    def __init__(self, links: DataFrame, task_nodes: int = TASK_NODES, last_nodes: int = LAST_NODES):
        self.spark = links.sparkSession
        self.stash = Stash(self.spark, "hierarchy")
        links = self.stash.put(links.select("child", "parent"))
        self.code: Column = _encoder(links)
        self.links = links.select("child", "parent", self.code(F.col("child")).alias("c"), self.code(F.col("parent")).alias("p"))
        parents = self.links.select(F.col("p").alias("c")).distinct()
        inner = self.links.select("c", "p").join(parents, "c", "left_semi").select("c", F.col("p").alias("top"), F.lit(1).cast("long").alias("off"), F.lit(False).alias("loop"))
        self.forest = self._merged(self.stash.put(inner), task_nodes, last_nodes)

    def _merged(self, now: DataFrame, task_nodes: int, last_nodes: int) -> DataFrame:
        levels = []
        while True:
            n = now.count()
            groups = 1 if n <= last_nodes else max(GROUPS, -(-n // task_nodes))
            local = self.stash.put(now.groupBy(F.pmod(F.xxhash64("c", F.lit(len(levels))), F.lit(groups))).applyInArrow(_compress, "c long, top long, off long, loop boolean"))
            if groups == 1:
                break
            ends = local.filter("not loop").select(F.col("top").alias("k")).distinct()
            now = self.stash.put(local.join(ends, F.col("c") == F.col("k"), "left_semi"))
            if now.count() > SHRINK * n:
                local = self._doubled(local)
                break
            levels.append(local)
        for level in reversed(levels):
            new = self.stash.put(_continued(level, local))
            self.stash.drop(local)
            local = new
        return local

    def _doubled(self, forest: DataFrame) -> DataFrame:
        """Doubles the links that every entry covers until all entries end; entries that still go on then lie on or below a loop."""
        open_before = None
        while True:
            nodes = forest.select(F.col("c").alias("n"))
            still = forest.filter("not loop").join(nodes, F.col("top") == F.col("n"), "left_semi").count()
            if still == 0 or still == open_before:
                break
            open_before = still
            new = self.stash.put(_continued(forest, forest))
            self.stash.drop(forest)
            forest = new
        if still:
            nodes = forest.select(F.col("c").alias("n"), F.lit(True).alias("on"))
            forest = self.stash.put(forest.join(nodes, F.col("top") == F.col("n"), "left").select("c", "top", "off", (F.col("loop") | F.coalesce("on", F.lit(False))).alias("loop")))
        return forest

    def nodes(self) -> DataFrame:
        """``(node, root, depth)`` for every child."""
        found = self.links.join(self.forest.withColumnRenamed("c", "k"), F.col("p") == F.col("k"), "left")
        found = found.select("child", F.coalesce("top", "p").alias("r"), (F.coalesce("off", F.lit(0)) + 1).alias("d"), F.coalesce("loop", F.lit(False)).alias("loop"))
        # a root is a parent that is nobody's child; its text comes from the links that name it
        tops = self.links.join(self.links.select(F.col("c").alias("k")), F.col("p") == F.col("k"), "left_anti").groupBy(F.col("p").alias("r")).agg(F.min("parent").alias("name"))
        named = found.join(checked_broadcast(tops, 128), "r", "left")
        return named.select(F.col("child").alias("node"), F.when(F.col("loop"), CYCLE).otherwise(F.col("name")).alias("root"), F.when(F.col("loop"), F.lit(-1)).otherwise(F.col("d")).cast("long").alias("depth"))

    def loops(self) -> DataFrame:
        """``(node, parent)``: the links that lie on a loop, not those below one.

        Every node on or below a loop leads, after as many links as it lies below, to a node on the loop. Walks are doubled until the
        nodes they end at no longer grow fewer: these are then the loops' nodes.
        """
        bad = self.links.join(self.forest.filter("loop").select(F.col("c").alias("k")), F.col("c") == F.col("k"), "left_semi").select("child", "parent", "c", "p")
        bad = self.stash.put(bad)
        walk, before = bad.select("c", F.col("p").alias("to")), None
        while True:
            ends = walk.select("to").distinct()
            size = ends.count()
            if size == before:
                return bad.join(ends.select(F.col("to").alias("k")), F.col("c") == F.col("k"), "left_semi").select(F.col("child").alias("node"), "parent")
            before = size
            new = self.stash.put(walk.join(walk.select(F.col("c").alias("k"), F.col("to").alias("on")), F.col("to") == F.col("k")).select("c", F.col("on").alias("to")))
            self.stash.drop(walk)
            walk = new

    def paths(self) -> DataFrame:
        """``(node, path, depth)``: the texts from the root to each acyclic child. Inner nodes' paths are put together by doubling."""
        inner = self.forest.filter("not loop").select(F.col("c").alias("k"))
        step = self.links.join(inner, F.col("c") == F.col("k"), "left_semi").select("c", F.array("parent").alias("up"), F.col("p").alias("next"))
        seg = self.stash.put(step)
        while True:
            more = seg.select(F.col("c").alias("k"), F.col("up").alias("above"), F.col("next").alias("beyond"))
            longer = seg.join(more, F.col("next") == F.col("k"), "left")
            if longer.filter("k is not null").limit(1).count() == 0:
                break
            new = self.stash.put(longer.select("c", F.when(F.col("k").isNotNull(), F.concat("up", "above")).otherwise(F.col("up")).alias("up"), F.coalesce("beyond", "next").alias("next")))
            self.stash.drop(seg)
            seg = new
        looped = self.forest.filter("loop").select(F.col("c").alias("k"))
        fine = self.links.join(looped, F.col("p") == F.col("k"), "left_anti")
        above = fine.join(seg.select(F.col("c").alias("k"), "up"), F.col("p") == F.col("k"), "left")
        path = F.concat(F.reverse(F.coalesce("up", F.array().cast("array<string>"))), F.array("parent", "child"))
        return above.select(F.col("child").alias("node"), path.alias("path"), (F.size(path) - 1).cast("long").alias("depth"))

    def descendants(self) -> DataFrame:
        """``(node, descendant, distance)`` for every acyclic node above another."""
        rows = self.paths().select("node", F.posexplode("path").alias("at", "above"), "depth")
        return rows.filter("at < depth").select(F.col("above").alias("node"), F.col("node").alias("descendant"), (F.col("depth") - F.col("at")).cast("long").alias("distance"))

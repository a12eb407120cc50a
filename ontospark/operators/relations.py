"""Relations: resolution, grouping, splits, sampling and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ontospark.operators.order import numbered


def last_by_text(entities: DataFrame, text: str, pos: str) -> DataFrame:
    """``(text, id)``: the last entity of each text; null and empty texts are left out."""
    return entities.filter(F.length(text) > 0).groupBy(F.col(text).alias("text")).agg(F.max(pos).alias("id"))


def resolve(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations with ``parent_id`` and ``child_id``, null where the text names nothing."""
    p = names.select(F.col("text").alias("parent"), F.col("id").alias("parent_id"))
    c = names.select(F.col("text").alias("child"), F.col("id").alias("child_id"))
    return relations.join(p, "parent", "left").join(c, "child", "left")


def in_one_group(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """``(grp, parent_id, child_id)``: distinct pairs whose ends share a group ``(id, grp)``."""
    p, c = groups.select(F.col("id").alias("parent_id"), F.col("grp")), groups.select(F.col("id").alias("child_id"), F.col("grp").alias("g2"))
    return pairs.join(p, "parent_id").join(c, "child_id").filter("grp = g2").select("grp", "parent_id", "child_id").distinct()


def child_parents(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("child_id").agg(F.sort_array(F.collect_set("parent_id")).alias("parents"))


def group_weights(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """``(grp, n, weight)``: a group's share of the relations; equal shares when there are none (A4)."""
    n = groups.select("grp").distinct().join(pairs.groupBy("grp").count(), "grp", "left").select("grp", F.coalesce("count", F.lit(0)).alias("n"))
    total, every = F.sum("n").over(Window.partitionBy()), F.count("*").over(Window.partitionBy())
    return n.select("grp", "n", F.when(total == 0, 1 / every).otherwise(F.try_divide("n", total)).alias("weight"))


def chance(key: Column, seed: int) -> Column:
    """A number in (0, 1) from a key, the same in any engine with md5."""
    return (F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))


def split_groups(df: DataFrame, id_col: str, group_col: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``(id, grp, side)``: ceil(share * n) rows of each group are test, by hash order; groups of one row are train (M1).

    A hash cut finds the few rows near the boundary; only counts per (group, hash bucket) are windowed, so a hot group is not sorted."""
    rows = df.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))).alias("h"))
    rows = rows.withColumn("bucket", F.substring("h", 1, 3))
    counts = rows.groupBy("grp", "bucket").agg(F.count("*").alias("n"))
    w = Window.partitionBy("grp")
    ahead = counts.select("grp", "bucket", F.coalesce(F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(w).alias("size"))
    rank = F.row_number().over(Window.partitionBy("grp", "bucket").orderBy("h", "id")) + F.col("before")
    placed = rows.alias("r").join(ahead.alias("a"), F.expr("r.grp <=> a.grp and r.bucket = a.bucket")).select("id", "r.grp", "h", "r.bucket", "before", "size")
    return placed.select("id", "grp", F.when((F.col("size") >= 2) & (rank <= F.ceil(F.lit(share) * F.col("size"))), "test").otherwise("train").alias("side"))


def split_relations(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """Pairs with ``side``: that of both ends, or ``mixed``."""
    p, c = sides.select(F.col("id").alias("parent_id"), F.col("side").alias("ps")), sides.select(F.col("id").alias("child_id"), F.col("side").alias("cs"))
    return pairs.join(p, "parent_id").join(c, "child_id").select("parent_id", "child_id", F.when(F.col("ps") == F.col("cs"), F.col("ps")).otherwise("mixed").alias("side"))


def sample_uniform(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    return df.withColumn("u", chance(F.col(id_col), seed)).orderBy("u", id_col).limit(n)


def sample_weighted(df: DataFrame, id_col: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """Without replacement, chances in proportion to ``weight`` (order by -ln(u)/w); rows without a positive weight are left out."""
    return df.filter(F.col(weight) > 0).withColumn("key", -F.log(chance(F.col(id_col), seed)) / F.col(weight)).orderBy("key", id_col).limit(n)


def sample_with_replacement(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``(draw, id)``: ``n`` draws; each asks for a position by hash."""
    pos = numbered(df.select(F.col(id_col).alias("id")), "id")
    size = df.count()
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(chance(F.col("id"), seed) * size).cast("long").alias("pos"))
    return draws.join(pos, "pos").select("draw", "id")


def _by_chance(df: DataFrame, n: int, seed: int, salt: str, weight: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group in the order of a chance per id, with ``rank`` from 0; by ``weight``, chances in proportion."""
    u = chance(F.concat(F.lit(salt), F.col("id").cast("string")), seed)
    key = u if weight is None else -F.log(u) / F.col(weight)
    w = Window.partitionBy("grp").orderBy("key", "id")
    return df.withColumn("key", key).withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < n)


def draw(df: DataFrame, n: int, seed: int = 42, salt: str = "") -> DataFrame:
    """``(grp, draw, id)``: ``n`` of each group's rows ``(grp, id)``, without replacement where it has as many, else with (M3)."""
    first = _by_chance(df.select("grp", "id").distinct(), n, seed, salt)
    size = first.groupBy("grp").agg(F.count("*").alias("size"))
    few = size.filter(F.col("size") < n).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    at = F.floor(chance(F.concat(F.lit(salt), F.col("grp").cast("string"), F.lit("#"), F.col("draw").cast("string")), seed) * F.col("size")).cast("int")
    again = few.select("grp", "draw", at.alias("rank")).join(first.select("grp", "rank", "id"), ["grp", "rank"]).select("grp", "draw", "id")
    return first.join(size.filter(F.col("size") >= n), "grp", "left_semi").select("grp", F.col("rank").alias("draw"), "id").unionByName(again)


def balanced_batch(entities: DataFrame, pairs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``(grp, side, pos, id)``: for each group of ``(grp, id)`` up to ``n`` children, drawn from all its entities alike, and up to ``n``
    parents: first those of the drawn children, chances in proportion to how many of these they have, then any others (M4).

    ``pairs (parent_id, child_id)`` count where both ends are of the group. Null ids and repeats are left out; a smaller group gives all it
    has; a group without relations draws both sides alike."""
    every = entities.select("grp", "id").filter("id is not null").distinct()
    kids = _by_chance(every, n, seed, "c").select("grp", "id", F.col("rank").alias("pos"))
    near = pairs.select("parent_id", "child_id").distinct().join(kids.select("grp", F.col("id").alias("child_id")), "child_id")
    linked = near.groupBy("grp", F.col("parent_id").alias("id")).agg(F.count("*").cast("double").alias("w")).join(every, ["grp", "id"], "left_semi")
    first = _by_chance(linked, n, seed, "p", "w").select("grp", "id", F.lit(0).alias("tier"), "rank")
    more = _by_chance(every.join(linked, ["grp", "id"], "left_anti"), n, seed, "o").select("grp", "id", F.lit(1).alias("tier"), "rank")
    pos = F.row_number().over(Window.partitionBy("grp").orderBy("tier", "rank")) - 1
    parents = first.unionByName(more).withColumn("pos", pos).filter(F.col("pos") < n)
    side = lambda df, name: df.select("grp", F.lit(name).alias("side"), "pos", "id")
    return side(kids, "child").unionByName(side(parents, "parent"))


def related_batch(pairs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``(grp, side, pos, id)``: for each group of ``(grp, parent_id, child_id)`` ``n`` of its children and ``n`` of its parents: up to
    half of these are parents of the drawn children, the others any but those (M5). With replacement where there are too few."""
    p = pairs.select("grp", "parent_id", "child_id").distinct()
    kids = draw(p.select("grp", F.col("child_id").alias("id")), n, seed, "c")
    related = p.join(kids.select("grp", F.col("id").alias("child_id")).distinct(), ["grp", "child_id"]).select("grp", F.col("parent_id").alias("id")).distinct()
    first = _by_chance(related, n // 2, seed, "r").select("grp", "id", F.col("rank").alias("pos"))
    parents = p.select("grp", F.col("parent_id").alias("id")).distinct()
    others = parents.join(first, ["grp", "id"], "left_anti")
    alone = parents.join(others.select("grp").distinct(), "grp", "left_anti")  # no other parent: any again
    more = draw(others.unionByName(alone), n, seed, "o")
    taken = first.groupBy("grp").agg(F.count("*").alias("taken"))
    more = more.join(taken, "grp").filter(F.col("draw") < n - F.col("taken")).select("grp", "id", (F.col("draw") + F.col("taken")).alias("pos"))
    side = lambda df, name: df.select("grp", F.lit(name).alias("side"), F.col("pos").cast("int").alias("pos"), "id")
    return side(kids.withColumnRenamed("draw", "pos"), "child").unionByName(side(first, "parent")).unionByName(side(more, "parent"))


def off_diagonal_sample(n: int, draws: DataFrame, seed: int = 42) -> DataFrame:
    """``(draw, i, j)``: positions i <> j below ``n``, all alike likely, with replacement (M7); ``n`` below 2 gives none."""
    u = lambda s: chance(F.concat(F.lit(s), F.col("draw").cast("string")), seed)
    i, j = F.floor(u("i") * n).cast("long"), F.floor(u("j") * (n - 1)).cast("long")
    return draws.select("draw", i.alias("i"), j.alias("j")).select("draw", "i", (F.col("j") + (F.col("j") >= F.col("i")).cast("long")).alias("j")).filter(F.lit(n > 1))


def phrase_sets(terms: DataFrame, examples: DataFrame, least: int = 5, most: int = 20, seed: int = 42) -> DataFrame:
    """``(example, at, term)``: for each example ``least`` to ``most`` different terms (M8).

    ``2 * most`` positions are drawn for an example and the first different ones kept, so that a table of few terms may give fewer. Null
    terms and repeats are left out."""
    every = numbered(terms.select("term").filter("term is not null").distinct(), "term")
    n = every.count()
    u = lambda s: chance(F.concat(F.lit(s), F.col("example").cast("string")), seed)
    asked = examples.select("example", (least + F.floor(u("n") * (most - least + 1))).cast("int").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(2 * most - 1))).alias("k"))
    at = F.floor(chance(F.concat(F.col("example").cast("string"), F.lit("#"), F.col("k").cast("string")), seed) * n).cast("long")
    first = asked.withColumn("pos", at).groupBy("example", "size", "pos").agg(F.min("k").alias("k"))
    kept = first.withColumn("at", F.row_number().over(Window.partitionBy("example").orderBy("k")) - 1).filter(F.col("at") < F.col("size"))
    return kept.join(every, "pos").select("example", "at", "term")


def phrase_labels(sets: DataFrame, links: DataFrame) -> DataFrame:
    """``(example, child, parent, y)`` for every two terms of an example: 1 where ``links (child, parent)`` has them (at most ``most``
    squared rows an example)."""
    a, b = sets.select("example", F.col("term").alias("child")), sets.select("example", F.col("term").alias("parent"))
    return a.join(b, "example").join(links.select("child", "parent", F.lit(1).alias("y")).distinct(), ["child", "parent"], "left").select("example", "child", "parent", F.coalesce("y", F.lit(0)).alias("y"))


def batch_count(n: int, *sizes: int, least: int = 1) -> int:
    """Batches of an epoch (M9)."""
    return max(least, n // max(sizes))


def batches(df: DataFrame, by: str, size: int) -> DataFrame:
    """``df`` with ``batch`` and ``slot``: rows in the order of ``by``, ``size`` to a batch."""
    return numbered(df, by, "_pos").withColumns({"batch": F.floor(F.col("_pos") / size), "slot": F.pmod("_pos", F.lit(size))}).drop("_pos")


def zipped(left: DataFrame, right: DataFrame, by_left: str, by_right: str) -> DataFrame:
    """Rows of both tables that have the same position in their orders; the longer one's others are left out."""
    return numbered(left, by_left, "_pos").join(numbered(right, by_right, "_pos"), "_pos").drop("_pos")


def full_matrix(scores: DataFrame, links: DataFrame) -> DataFrame:
    """``(i, j, score, y)``: a score table with 1 where ``links (i, j)`` has the pair, any number of times."""
    return scores.join(links.select("i", "j", F.lit(1).alias("y")).distinct(), ["i", "j"], "left").fillna(0, ["y"])


def with_text(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of ids with ``parent`` and ``child`` texts of ``names (id, text)``, empty where an id has none."""
    p, c = names.select(F.col("id").alias("parent_id"), F.col("text").alias("parent")), names.select(F.col("id").alias("child_id"), F.col("text").alias("child"))
    return pairs.join(p, "parent_id", "left").join(c, "child_id", "left").fillna("", ["parent", "child"])


def with_id(terms: DataFrame, names: DataFrame, term: str = "term") -> DataFrame:
    """Terms with the ``id`` of ``names (id, text)``, -1 where there is none."""
    return terms.join(names.select(F.col("text").alias(term), "id"), term, "left").fillna(-1, ["id"])


def known_terms(relations: DataFrame, terms: DataFrame, absent: bool = False) -> DataFrame:
    """Relations whose both ends are among ``terms (term)``, or those of which an end is not."""
    t = terms.select("term").distinct()
    good = relations.join(t.select(F.col("term").alias("parent")), "parent", "left_semi").join(t.select(F.col("term").alias("child")), "child", "left_semi")
    if not absent:
        return good
    no_parent = relations.join(t.select(F.col("term").alias("parent")), "parent", "left_anti")
    return no_parent.unionByName(relations.join(t.select(F.col("term").alias("parent")), "parent", "left_semi").join(t.select(F.col("term").alias("child")), "child", "left_anti"))


def relation_matrix(children: DataFrame, parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(child_id, parent_id, y)`` for a batch: every child with every parent, 1 where related. A batch is small by construction."""
    grid = children.select(F.col("id").alias("child_id")).join(F.broadcast(parents.select(F.col("id").alias("parent_id"))))
    return grid.join(pairs.select("child_id", "parent_id", F.lit(1).alias("y")).distinct(), ["child_id", "parent_id"], "left").fillna(0, ["y"])


def choose_group(weights: DataFrame, draws: DataFrame, how: str = "weighted", seed: int = 42) -> DataFrame:
    """``(draw, grp)`` of ``weights (grp, weight)``: weighted, sequential (draw after draw), random, or single, the first (M6). Groups are
    few: one row each."""
    w = Window.partitionBy().orderBy("grp")
    by = weights.select("grp", F.sum("weight").over(w).alias("hi"), (F.sum("weight").over(w) - F.col("weight")).alias("lo"), (F.row_number().over(w) - 1).alias("at"), F.count("*").over(Window.partitionBy()).alias("n"))
    u = draws.select("draw", chance(F.col("draw"), seed).alias("u"))
    on = {
        "weighted": (F.col("u") > F.col("lo")) & (F.col("u") <= F.col("hi")),
        "sequential": F.pmod("draw", F.col("n")) == F.col("at"),
        "random": F.floor(F.col("u") * F.col("n")) == F.col("at"),
        "single": F.col("at") == 0,
    }
    return u.join(F.broadcast(by), on[how]).select("draw", "grp")


def entity_issues(entities: DataFrame, id_col: str = "id", text: str = "text_description", vec: str = "embedding") -> DataFrame:
    """``(id, issue)`` of rows that fail validation."""
    issue = F.when(F.col(id_col).isNull(), "no id").when(F.col(vec).isNull() | (F.size(vec) == 0), "no embedding").when(F.col(text).isNull() | (F.trim(text) == ""), "no text")
    return entities.select(F.col(id_col).alias("id"), issue.alias("issue")).filter("issue is not null")


def entity_report(entities: DataFrame, id_col: str = "id", text: str = "text_description", vec: str = "embedding", group: str = "dataset") -> DataFrame:
    """``(total, valid, dims, datasets, consistent)``."""
    bad = F.col(id_col).isNull() | F.col(vec).isNull() | (F.size(vec) == 0) | F.col(text).isNull() | (F.trim(text) == "")
    dims = F.count_distinct(F.when(F.size(vec) > 0, F.size(vec)))
    return entities.agg(F.count("*").alias("total"), F.count_if(~bad).alias("valid"), dims.alias("dims"), F.count_distinct(group).alias("datasets"), (dims == 1).alias("consistent"))


def relation_report(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(total, valid, distinct_pairs, unknown_parent, unknown_child)``."""
    p, c = ids.select(F.col("id").alias("parent_id"), F.lit(1).alias("kp")).distinct(), ids.select(F.col("id").alias("child_id"), F.lit(1).alias("kc")).distinct()
    j = pairs.join(p, "parent_id", "left").join(c, "child_id", "left")
    return j.agg(F.count("*").alias("total"), F.count_if(F.expr("kp = 1 and kc = 1")).alias("valid"), F.count_distinct("parent_id", "child_id").alias("distinct_pairs"), F.count_if(F.expr("parent_id is not null and kp is null")).alias("unknown_parent"), F.count_if(F.expr("child_id is not null and kc is null")).alias("unknown_child"))


def validation_report(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for both tables: all figures of :func:`entity_report` and :func:`relation_report`, and ``ok`` where no row of either fails."""
    e = entity_report(entities).withColumnsRenamed({"total": "entities", "valid": "valid_entities"})
    r = relation_report(pairs, entities.select("id")).withColumnsRenamed({"total": "relations", "valid": "valid_relations"})
    return e.join(F.broadcast(r)).withColumn("ok", F.expr("entities = valid_entities and relations = valid_relations and coalesce(consistent, false)"))


def dataset_info(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(grp, entities, relations, distinct_relations)`` of ``groups (id, grp)``: relations stated within a group, repeats counted and not."""
    ends = pairs.join(groups.select(F.col("id").alias("parent_id"), "grp"), "parent_id").join(groups.select(F.col("id").alias("child_id"), F.col("grp").alias("g2")), "child_id").filter("grp = g2")
    stated = ends.groupBy("grp", "parent_id", "child_id").agg(F.count("*").alias("n")).groupBy("grp").agg(F.sum("n").alias("relations"), F.count("*").alias("distinct_relations"))
    return groups.groupBy("grp").agg(F.count("*").alias("entities")).join(stated, "grp", "left").fillna(0)

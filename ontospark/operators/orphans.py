"""Problem 2: references to records that do not exist at the time of the reference.

Keys are integers (ids as they are, texts by a hash that a second one has shown free of collisions on the very data) and dealt into key ranges. In each
range they are numbered by a dictionary of its own, and for each month two compressed bitmaps are built over these numbers: the keys that
references name, and the keys that are available throughout the month. ``reference AND NOT available`` is taken container by container and
the surviving bits decoded. Only references behind a surviving bit are compared with exact times, of which a key and month have at most
two that matter, and the records that live within a month.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontospark.functions.text import term_key
from ontospark.runtime import Stash, checked_broadcast

#: Rows of (key, month) and spans that one key range holds on average; a container's bits, and up to how many are kept as a list.
RANGE_ROWS, CONTAINER, LISTED = 1 << 16, 1 << 16, 4096
#: References of one key and month beyond which they are dealt into parts of so many.
HOT_ROWS = 100_000


def _month(at: Column) -> Column:
    """Months since year 0."""
    return F.year(at) * 12 + F.month(at)


def compressed(bits: np.ndarray) -> np.ndarray:
    """A container of the set bits: their positions while they are few, packed bits otherwise."""
    at = np.flatnonzero(bits)
    return at.astype(np.uint16) if len(at) <= LISTED else np.packbits(np.concatenate([bits, np.zeros(CONTAINER - len(bits), bool)]))


def and_not(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Positions that are set in the first container and not in the second."""
    listed_one, listed_two = one.dtype == np.uint16, two.dtype == np.uint16
    if listed_one:
        gone = np.isin(one, two) if listed_two else (two[one >> 3] >> (7 - (one & 7)).astype(np.uint8)) & 1 == 1
        return one[~gone]
    left = np.unpackbits(one).astype(bool) if listed_two else np.unpackbits(one & ~two).astype(bool)
    if listed_two:
        left[two] = False
    return np.flatnonzero(left)


_OPEN = pa.schema([("key", pa.int64()), ("month", pa.int32())])


def _open_bits(t: pa.Table) -> pa.Table:
    """``(key, month)`` of references (rows without ``until``) whose key is not available throughout the month (rows with both ends)."""
    key, month = t.column("key").to_numpy(), t.column("month").to_numpy()
    until = t.column("until").to_numpy(zero_copy_only=False)
    asked = np.isnan(until.astype(float))
    found = []
    names, code = np.unique(key, return_inverse=True)
    low, high = int(month[asked].min(initial=1 << 30)), int(month[asked].max(initial=-1))
    span = max(0, high - low + 1)
    for first in range(0, len(names) if span else 0, CONTAINER):
        own = (code >= first) & (code < first + CONTAINER)
        size = min(CONTAINER, len(names) - first)
        change = np.zeros((span + 1, size), np.int32)
        rows = own & ~asked
        begin, end = np.clip(month[rows] - low, 0, span), np.clip(until[rows].astype(np.int64) - low, 0, span)
        np.add.at(change, (begin, code[rows] - first), 1)
        np.add.at(change, (end, code[rows] - first), -1)
        have = np.cumsum(change[:-1], axis=0) > 0
        want = np.zeros((span, size), bool)
        want[month[own & asked] - low, code[own & asked] - first] = True
        for m in range(span):
            at = and_not(compressed(want[m]), compressed(have[m]))
            found.append((names[first + at.astype(np.int64)], np.full(len(at), low + m, np.int32)))
    if not found:
        return _OPEN.empty_table()
    return pa.table([pa.array(np.concatenate([f[c] for f in found])) for c in range(2)], schema=_OPEN)


def _settle(refs: DataFrame, spans: DataFrame, stash: Stash) -> DataFrame:
    """The references ``(tbl, ref_key, side, key, at)`` without a span of their key that holds ``at``."""
    placed = refs.withColumn("month", _month(F.col("at")).cast("int"))
    asked = stash.put(placed.groupBy("key", "month").agg(F.count("*").alias("n")))
    edge = asked.agg(F.min("month").alias("low"), F.max("month").alias("high"), F.count("*").alias("n")).first()
    low, high = edge.low or 0, edge.high or 0
    # months wholly inside a span
    began, ended = _month(F.col("since")), _month(F.col("until"))
    first = began + F.when(F.col("since") > F.date_trunc("month", "since"), 1).otherwise(0)
    wide = spans.select("key", F.greatest(first, F.lit(low)).cast("int").alias("month"), F.least(F.coalesce(ended, F.lit(high + 1)), F.lit(high + 1)).cast("int").alias("until")).filter("month < until").distinct()
    both = asked.select("key", "month", F.lit(None).cast("int").alias("until")).unionByName(wide)
    ranges = -(-(edge.n + spans.count()) // RANGE_ROWS) or 1
    left = both.groupBy(F.pmod(F.xxhash64("key"), F.lit(ranges))).applyInArrow(_open_bits, "key long, month int")
    # decode: the references whose bit survived; those of a very frequent key and month in parts
    left = stash.put(left.join(asked, ["key", "month"]).select("key", "month", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("parts")))
    hot = checked_broadcast(left.filter("parts > 1"), 32)  # at most references / HOT_ROWS rows
    salt = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("ref_key", "side"), F.col("parts"))).cast("int")
    dealt = left.select("key", "month", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    doubt = placed.join(hot, ["key", "month"], "left").withColumn("salt", salt).drop("parts").join(dealt, ["key", "month", "salt"])
    # exact times: in the month in which spans begin the earliest, in that in which they end the latest
    kind = spans.schema["since"].dataType
    lasting = F.col("until").isNull() | (ended > began)
    begins = spans.filter(lasting).groupBy("key", began.cast("int").alias("month")).agg(F.min("since").alias("from"), F.lit(None).cast(kind).alias("upto"))
    ends = spans.filter(ended > began).groupBy("key", ended.cast("int").alias("month")).agg(F.lit(None).cast(kind).alias("from"), F.max("until").alias("upto"))
    edges = begins.unionByName(ends).groupBy("key", "month").agg(F.min("from").alias("from"), F.max("upto").alias("upto"))
    edges = edges.join(dealt, ["key", "month"])
    inside = F.coalesce(F.col("at") >= F.col("from"), F.lit(False)) | F.coalesce(F.col("at") < F.col("upto"), F.lit(False))
    doubt = stash.put(doubt.join(edges, ["key", "month", "salt"], "left").filter(~inside).select("tbl", "ref_key", "side", "key", "at", "month", "salt"))
    # records that live within one month
    short = spans.filter((ended == began) & (F.col("until") > F.col("since"))).select("key", began.cast("int").alias("month"), "since", "until").distinct().join(dealt, ["key", "month"])
    on = F.expr("d.key = s.key and d.month = s.month and d.salt = s.salt and d.at >= s.since and d.at < s.until")
    return doubt.alias("d").join(short.alias("s"), on, "left_anti").select("tbl", "ref_key", "side", "at")


def _dictionary(stash: Stash, wanted: DataFrame) -> DataFrame:
    """``(text, key)``: an integer for each distinct text, fixed by being written."""
    return stash.put(wanted.distinct().select("text", F.monotonically_increasing_id().alias("key")))


def _unique_code(texts: DataFrame):
    """A 64-bit hash under which no two of the texts share a code, as a second, independent hash tells; None if 16 seeds all fail."""
    for seed in range(42, 58):
        by = texts.groupBy(F.xxhash64("text", F.lit(seed)).alias("k")).agg(F.min(F.xxhash64(F.lit(seed), "text")).alias("a"), F.max(F.xxhash64(F.lit(seed), "text")).alias("b"))
        if by.filter("a <> b").limit(1).count() == 0:
            return lambda text, s=seed: F.xxhash64(text, F.lit(s))
    return None


def orphan_references(entities: DataFrame, top_terms: DataFrame, relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(tbl, ref_key, side, at)``: references, neither null nor blank, without an available target at the row's ``added_at``.

    A record is available from ``added_at`` (included) to ``deleted_at`` (excluded; null: for ever). Records without ``added_at`` are
    never available; references without ``added_at`` or without their row's key are left out; the same reference delivered twice
    counts once. Texts are compared as in :func:`term_key`. Empty tables: no references give no rows, no records make all orphans.
    """
    stash = Stash(entities.sparkSession, "orphans")
    ends = lambda df, name, key, a, b, cast: df.select(
        F.lit(name).alias("tbl"), F.col(key).cast("string").alias("ref_key"), F.col("added_at").alias("at"),
        F.explode(F.array(F.struct(F.lit("parent").alias("side"), cast(F.col(a)).alias("target")), F.struct(F.lit("child").alias("side"), cast(F.col(b)).alias("target")))).alias("e"),
    ).select("tbl", "ref_key", "at", "e.side", "e.target").filter("target is not null and at is not null and ref_key is not null")
    named = ends(relations, "relations", "rel_id", "parent", "child", term_key).filter("target <> ''").distinct()
    byid = ends(pairs, "relation_pairs", "pair_id", "parent_id", "child_id", lambda c: c.cast("long")).distinct()
    live = entities.select("id", term_key(F.col("text_description")).alias("text"), F.col("added_at").alias("since"), F.col("deleted_at").alias("until")).filter("since is not null")
    terms = top_terms.select(term_key(F.col("term")).alias("text"), F.col("added_at").alias("since"), F.lit(None).cast(top_terms.schema["added_at"].dataType).alias("until")).filter("since is not null")
    texts = live.select("text", "since", "until").unionByName(terms).filter("text <> ''")
    code = _unique_code(named.select(F.col("target").alias("text")).unionByName(texts.select("text")))
    if code is not None:
        spans, refs = texts.withColumn("key", code(F.col("text"))), named.withColumn("key", code(F.col("target")))
    else:
        words = _dictionary(stash, named.select(F.col("target").alias("text")))
        spans, refs = texts.join(words, "text"), named.join(words.withColumnRenamed("text", "target"), "target")
    open_texts = _settle(refs.select("tbl", "ref_key", "side", "key", "at"), spans.select("key", "since", "until"), stash)
    open_ids = _settle(byid.select("tbl", "ref_key", "side", F.col("target").alias("key"), "at"), live.select(F.col("id").alias("key"), "since", "until").filter("key is not null"), stash)
    return open_texts.unionByName(open_ids)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """``(tbl, month, side, orphans)`` per table and month of the reference."""
    return orphans.groupBy("tbl", F.date_format("at", "yyyy-MM").alias("month"), "side").agg(F.count("*").alias("orphans"))

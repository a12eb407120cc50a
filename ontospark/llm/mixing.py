"""Problem 8: mixing sources to target shares by systematic sampling, sizes counted in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ontospark.runtime import Stash, checked_broadcast

#: Where the public vocabularies lie; files are read there on every executor and never copied.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Documents of a source that one task numbers in order.
RUN_ROWS = 50_000
# fixed value: the split pattern that belongs to the byte-level vocabularies
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(text: Column, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of each whole text; null stays null."""
    path = f"{tokenizers}/{vocabulary}"

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(path)
        for texts in parts:
            # repeated texts of a batch are encoded once
            code, once = pd.factorize(texts)
            sizes = np.array([len(enc.encode_ordinary(t)) for t in once] + [0], np.int64)
            yield pd.Series(sizes[code]).astype("Int64").mask(code < 0)

    return count(text)


def source_key(column: str) -> Column:
    """Sources are compared trimmed, in lower case, ``-`` as ``_``; null and empty stay null."""
    name = F.regexp_replace(F.lower(F.trim(F.col(column))), "[- ]", "_")
    return F.when(name == "", None).otherwise(name)


def _offset(source: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(source, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


class Mix:
    """A planned mixture: ``picks()`` has its rows, ``shares()`` the report.

    Texts: equal texts count as one, under the smallest id, so that none is used more than ``max_repeats`` times under other ids;
    null and empty texts, null ids and texts whose source has no target are left out. Total size: without ``total_tokens`` the
    largest at which every source reaches its share within its repeats, so the scarcest source sets the size of the whole mixture
    (sources without any text or with ``max_repeats`` below 1 give nothing and are left aside); with it, a
    source that can't reach its share gives all it has, ``max_repeats`` times, and the report shows the shares reached. Sampling:
    expected copies are equal within a source; they are summed in a fixed random order, one random offset is added, and a text comes
    out once for each whole number its interval crosses, so never more than ``max_repeats`` times. Repeated target rows: the largest
    share counts. Null or negative shares count as 0, null repeats as 1.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", total_tokens: float | None = None, seed: int = 17, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY):
        stash = Stash(docs.sparkSession, "mix")
        share = F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0))
        goal = targets.select(source_key("source").alias("source"), share.alias("target_share"), F.coalesce(F.col("max_repeats"), F.lit(1)).alias("max_repeats")).filter("source is not null")
        goal = checked_broadcast(goal.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max_by("max_repeats", "target_share").alias("max_repeats")), 256)
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), source_key(source).alias("source")).filter("doc_id is not null and length(text) > 0")
        rows = rows.join(goal.select("source"), "source", "left_semi")
        # the order of a text within its source, by a hash of the text
        # equal texts meet by two hashes; the text itself stays where it was read
        hashed = rows.withColumns({"at": F.xxhash64("text", F.lit(seed)), "as": F.xxhash64("text", F.lit(seed + 1))})
        counted = hashed.withColumn("tokens", token_counts(F.col("text"), tokenizers, vocabulary)).drop("text")
        once = counted.groupBy("at", "as").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("d")).select("at", "as", "d.*").filter("tokens > 0")
        self.texts = stash.put(once)
        sizes = self.texts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
        plan = goal.join(sizes, "source", "left").fillna(0, ["tokens", "docs"])
        reach = plan.filter("tokens > 0 and target_share > 0 and max_repeats > 0").agg(F.min(F.col("tokens") * F.col("max_repeats") / F.col("target_share"))).first()[0]
        self.total = float(total_tokens if total_tokens is not None else reach or 0.0)
        want = F.lit(self.total) * F.col("target_share")
        # one row per target
        rate = F.when((F.col("tokens") > 0) & (F.col("max_repeats") > 0), F.least(F.col("max_repeats").cast("double"), want / F.greatest("tokens", F.lit(1)))).otherwise(0.0)
        self.plan = stash.put(plan.withColumn("rate", rate).coalesce(1))
        self.seed = seed

    def sources(self) -> DataFrame:
        """``(source, target_share, max_repeats, docs)``: the targets and the distinct texts that each has to draw from."""
        return self.plan.select("source", "target_share", F.col("max_repeats").cast("long").alias("max_repeats"), "docs")

    def picks(self) -> DataFrame:
        """``(source, doc_id, tokens, copies)``: the texts drawn and how often each."""
        plan = F.broadcast(self.plan.select("source", "rate", "docs", "max_repeats"))  # one row per target, bounded when the goals were read
        rows = self.texts.join(plan, "source")
        # a source is cut into runs by the leading bits of the order, so that none is numbered in one task
        runs = 1 + F.floor(F.col("docs") / RUN_ROWS)
        rows = rows.withColumn("run", F.floor((F.col("at") / F.lit(2.0**64) + 0.5) * runs).cast("long"))
        count = rows.groupBy("source", "run").agg(F.sum("rate").alias("expected"))
        before = count.withColumn("before", F.coalesce(F.sum("expected").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("expected")
        order = Window.partitionBy("source", "run").orderBy("at", "doc_id")
        upto = F.col("before") + F.row_number().over(order) * F.col("rate") + _offset(F.col("source"), self.seed)
        placed = rows.join(before, ["source", "run"]).withColumn("upto", upto)
        # the tiny term keeps sums that should be whole numbers from falling below them
        crossed = F.floor(F.col("upto") + 1e-9) - F.floor(F.col("upto") - F.col("rate") + 1e-9)
        return placed.select("source", "doc_id", "tokens", F.least(crossed, F.col("max_repeats")).cast("long").alias("copies")).filter("copies > 0")

    def shares(self) -> DataFrame:
        """``(source, target_share, actual_share, used_tokens, used_docs, most_copies)``, one row per target."""
        used = self.picks().groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.count("*").alias("used_docs"), F.max("copies").alias("most_copies"))
        # one row per target, so the window over all of them is small
        every = self.plan.select("source", "target_share").join(used, "source", "left").fillna(0)
        total = F.sum("used_tokens").over(Window.partitionBy())
        return every.withColumn("actual_share", F.coalesce(F.try_divide("used_tokens", total), F.lit(0.0)))

"""Problem 4: records of evaluation splits that stand, exactly or nearly, in the training split, by an edit-distance segment join.

A description is the sequence of its distinct words in one fixed (hash) order, so the insertions and deletions between two sequences
number the words they do not share: with sizes a and b, a share of at least 0.8 means at most k = floor((a + b) / 9) edits, of the
parity of a + b. An evaluation sequence is cut into k + 1 segments for each size b it may meet; one of them stands unchanged in the
training sequence, shifted no further than the edits before and after it allow. Segments are matched with the substrings of training
sequences of that size, candidates pass a 64-bit parity sketch and are verified by banded dynamic programming.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontospark.llm.leaks import word_text
from ontospark.runtime import Stash, dataset_key

#: Sequences longer than this are cut once, for every size they may meet, as cutting for each size would cost the square of their length.
SIZED = 64

_K = "int((({a} + {b}) div 9) - pmod((({a} + {b}) div 9) + {a} + {b}, 2))"


def _k(a: str, b: str) -> str:
    return _K.format(a=a, b=b)


def _sizes(own: str, other: str) -> str:
    """Sizes that a sequence of ``own`` words may meet and differ from; ``other`` names the variable."""
    return f"filter(sequence(int(({own} * 4 + 4) div 5), int({own} * 5 div 4)), {other} -> {_k(own, other)} >= greatest(1, abs({own} - {other})))"


def _most(a: str) -> str:
    """Edits that no size can exceed."""
    return f"int(({a} + {a} * 5 div 4) div 9)"


def _verify() -> Column:
    """Whether two sequences lie within ``k`` insertions and deletions: dynamic programming over a band of 2k + 1 diagonals,
    all pairs of a batch at once."""

    def within(x: list, y: list, k: np.ndarray) -> np.ndarray:
        n, m = np.array([len(v) for v in x]), np.array([len(v) for v in y])
        pad = lambda rows, size, fill: np.stack([np.concatenate([r, np.full(size - len(r), fill, np.int64)]) for r in rows])
        band = int(k.max())
        a, b = pad(x, n.max() + 1, np.int64(-1)), pad(y, m.max() + 1, np.int64(-2))
        far = np.int32(1 << 20)
        cols = np.arange(2 * band + 1) - band
        row = np.where(cols >= 0, cols, far)[None, :].repeat(len(n), 0).astype(np.int32)
        done = np.full(len(n), far, np.int32)
        at = np.arange(len(n))
        done[n == 0] = m[n == 0]
        for i in range(1, int(n.max()) + 1):
            j = i + cols
            same = np.zeros((len(n), len(cols)), bool)
            ok = (j >= 1) & (j <= b.shape[1])
            same[:, ok] = (a[:, i - 1 : i] == b[:, j[ok] - 1]) & (j[ok] <= m[:, None])
            new = np.where(same, row, far)
            new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
            new[:, j < 0] = far
            for c in range(1, len(cols)):
                if j[c] >= 1:
                    new[:, c] = np.minimum(new[:, c], new[:, c - 1] + 1)
            if 0 <= -i + band < len(cols):
                new[:, -i + band] = i
            row = new
            end = (n == i) & (np.abs(m - i) <= band)
            done[end] = row[at[end], (m[end] - i) + band]
        return done <= k

    @F.pandas_udf("boolean")
    def close(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y, k in batches:
            out = np.zeros(len(x), bool)
            size = x.map(len).to_numpy() + y.map(len).to_numpy()
            order = np.argsort(size, kind="stable")  # alike lengths together, so that padding stays small
            for at in range(0, len(order), 1024):
                part = order[at : at + 1024]
                out[part] = within([x.iloc[p] for p in part], [y.iloc[p] for p in part], k.to_numpy()[part])
            yield pd.Series(out)

    return close


def _members(df: DataFrame, id_col: str, text_col: str, split_col: str, group_col: str) -> DataFrame:
    split = F.lower(F.trim(F.col(split_col)))
    rows = df.select(F.col(id_col).cast("long").alias("id"), split.alias("split"), dataset_key(group_col).alias("dataset"), word_text(F.col(text_col)).alias("t"))
    rows = rows.filter("id is not null and length(t) > 0 and split in ('train', 'test', 'dev')")
    words = F.array_sort(F.transform(F.array_distinct(F.split("t", " ")), lambda w: F.xxhash64(w)))
    return rows.select("id", "split", "dataset", words.alias("ws")).withColumns({"h": F.xxhash64("ws", F.size("ws")), "g": F.xxhash64(F.lit(7), "ws")})


def set_links(df: DataFrame, id_col: str = "id", text_col: str = "text_description", split_col: str = "split_name", group_col: str = "dataset") -> tuple[DataFrame, DataFrame]:
    """``(e_sig, t_sig)`` links between the distinct word sets of both sides, and ``(id, split, dataset, sig)`` membership.

    Words are compared by 64-bit hashes; a set is known by two independent hashes of all of them, and its number ``sig`` is its own."""
    stash = Stash(df.sparkSession, "overlaps")
    rows = _members(df, id_col, text_col, split_col, group_col)
    sketch = F.expr("aggregate(ws, 0L, (x, w) -> x ^ shiftleft(1L, int(w & 63)))")
    members = stash.put(rows)
    sets = members.groupBy("h", "g").agg(F.any_value("ws").alias("ws"), F.max(F.when(F.col("split") == "train", 1).otherwise(0)).alias("t"), F.max(F.when(F.col("split") != "train", 1).otherwise(0)).alias("e"))
    # numbered once and written: the numbers stay
    sets = stash.put(sets.withColumns({"n": F.size("ws"), "bits": sketch, "sig": F.monotonically_increasing_id()}))
    asked, base = sets.filter("e = 1 and n >= 4").selectExpr("sig as e_sig", "ws", "n as a", "bits as e_bits"), sets.filter("t = 1 and n >= 4").selectExpr("sig as t_sig", "ws", "n as b", "bits as t_bits")
    # evaluation side: segments i = 0..k, the longer ones last
    sized = asked.filter(F.col("a") <= SIZED).selectExpr("*", f"explode({_sizes('a', 'b')}) as size").selectExpr("*", f"{_k('a', 'size')} as k")
    free = asked.filter(F.col("a") > SIZED).selectExpr("*", "0 as size", f"{_most('a')} as k")
    cut = sized.unionByName(free).selectExpr("*", "posexplode(sequence(0, k)) as (i, i2)").selectExpr("e_sig", "e_bits", "a", "size", "k", "i", "ws", "int(a div (k + 1)) as w", "int(k + 1 - a % (k + 1)) as small")
    cut = cut.selectExpr("e_sig", "e_bits", "a", "size", "k", "i", "int(i * w + greatest(0, i - small)) as at", "ws", "int(w + if(i >= small, 1, 0)) as len").selectExpr("xxhash64(slice(ws, at + 1, len), size) as key", "e_sig", "e_bits", "a", "k", "i", "at as e_at")
    # training side: substrings of the lengths that such segments have
    cuts = f"array(int(a div ({_k('a', 'b')} + 1)), int((a + {_k('a', 'b')}) div ({_k('a', 'b')} + 1)))"
    lengths = f"array_distinct(flatten(transform(filter({_sizes('b', 'a')}, a -> a <= {SIZED}), a -> {cuts})))"
    own = base.filter(F.col("b") <= SIZED * 5 // 4).selectExpr("*", "b as size", f"explode({lengths}) as len")
    any_size = base.filter(F.col("b") >= SIZED * 4 // 5).selectExpr("*", "0 as size", "explode(array(3, 4)) as len")
    runs = own.unionByName(any_size).filter("len <= b").selectExpr("t_sig", "t_bits", "b", "size", "ws", "len", "explode(sequence(0, b - len)) as t_at").selectExpr("xxhash64(slice(ws, t_at + 1, len), size) as key", "t_sig", "t_bits", "b", "t_at")
    met = cut.join(runs, "key").filter(f"abs(t_at - e_at) <= i and abs((b - a) - (t_at - e_at)) <= k - i and {_k('a', 'b')} >= greatest(1, abs(a - b))")
    near = met.filter(f"bit_count(e_bits ^ t_bits) <= {_k('a', 'b')} and e_sig <> t_sig").select("e_sig", "t_sig").distinct()
    both = near.join(asked.select("e_sig", F.col("ws").alias("x"), "a"), "e_sig").join(base.select("t_sig", F.col("ws").alias("y"), "b"), "t_sig")
    linked = both.filter(_verify()(F.col("x"), F.col("y"), F.expr(_k("a", "b")))).select("e_sig", "t_sig")
    equal = sets.filter("e = 1 and t = 1").selectExpr("sig as e_sig", "sig as t_sig")
    return stash.put(linked.unionByName(equal)), members.select("id", "split", "dataset", "h", "g").join(sets.select("h", "g", "sig"), ["h", "g"]).select("id", "split", "dataset", "sig")


def overlap_pairs(df: DataFrame, **options) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: one record of train and one of test or dev whose sets of distinct words have at least 0.8 of
    their union in common.

    Null, blank and wordless texts, null ids and other or null splits are left out; splits are compared trimmed in lower case. Equal
    word sets are joined once, as sets; only the result lists their records in pairs. Long texts are compared whole.
    """
    links, members = set_links(df, **options)
    asked = members.filter("split <> 'train'").select(F.col("id").alias("e"), F.col("sig").alias("e_sig"))
    base = members.filter("split = 'train'").select(F.col("id").alias("t"), F.col("sig").alias("t_sig"))
    pairs = links.join(asked, "e_sig").join(base, "t_sig").filter("e <> t")
    return pairs.select(F.least("e", "t").alias("id_a"), F.greatest("e", "t").alias("id_b")).distinct()


def overlap_report(df: DataFrame, **options) -> DataFrame:
    """``(split, dataset, records, overlapping, exact)``: evaluation records with words, those that overlap with train, and those whose
    word set stands there unchanged."""
    links, members = set_links(df, **options)
    hit = links.groupBy(F.col("e_sig").alias("sig")).agg(F.max(F.when(F.col("e_sig") == F.col("t_sig"), 1).otherwise(0)).alias("same"))
    return members.filter("split <> 'train'").join(hit, "sig", "left").groupBy("split", "dataset").agg(
        F.count("*").alias("records"), F.count("same").alias("overlapping"), F.coalesce(F.sum("same"), F.lit(0)).alias("exact"))

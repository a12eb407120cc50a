"""Problem 7: evaluation passages inside training documents, by suffix arrays over shards of the corpus.

Each task turns its documents into word numbers and sorts the suffixes that can match (they begin with words of items) by prefix doubling:
ranks over 1, 2, 4, ... words, until the order holds for as many words as the longest item has. Every suffix of every item is looked up in
that order by binary search; matches are then extended to their full length and compared byte by byte. Items are few and broadcast in
blocks of bounded size; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontospark.runtime import Stash

#: Bytes of text that one suffix array covers, and bytes of items that one pass broadcasts.
SHARD, ITEM_BYTES = 4 << 20, 8 << 20
_BASE = 0x9E3779B97F4A7C15
_MATCH = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("words", pa.int32()), ("doc_at", pa.int32()), ("item_at", pa.int32())])


def word_text(text: Column) -> Column:
    """Words (longest runs of letters or digits) in lower case, one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, np.uint64(b), np.uint64), dtype=np.uint64)]) for b in (_BASE, inverse))


class Words:
    """The words of some texts in one byte string: start, end, hash and text number of each. Spaces and control bytes part words."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts) + b" "
        raw = np.frombuffer(self.data, np.uint8)
        space = raw <= 32
        before = np.concatenate([[True], space[:-1]])
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(space & ~before)
        bound = 1 << max(16, len(raw).bit_length())
        power, inverse = _powers(bound)
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)])
        self.hash = (total[self.end] - total[self.start]) * inverse[self.start]
        edge = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(edge, self.start, side="right")
        self.first = np.searchsorted(self.text, np.arange(len(texts)))
        self.last = np.searchsorted(self.text, np.arange(len(texts)), side="right")

    def piece(self, at: int, words: int) -> bytes:
        return self.data[self.start[at] : self.end[at + words - 1]]


class Suffixes:
    """Ranks of word runs by prefix doubling: ``rank[p][i]`` orders the runs of ``p`` words that begin at ``i``, for powers ``p`` of two.

    Word 0 stands for any word that no item has, and for what follows the end of a text; runs that hold one are rank 0.
    """

    def __init__(self, code: np.ndarray, longest: int):
        self.rank = {1: code}
        p = 1
        while p < longest:
            now = self.rank[p]
            after = np.concatenate([now[p:], np.zeros(min(p, len(now)), now.dtype)])[: len(now)]
            both = np.flatnonzero((now > 0) & (after > 0))
            new = np.zeros(len(now), np.int64)
            if len(both):
                new[both] = np.unique(now[both].astype(np.int64) * (int(after.max()) + 1) + after[both], return_inverse=True)[1] + 1
            p *= 2
            self.rank[p] = new

    def keys(self, at: np.ndarray, words: int) -> np.ndarray:
        """A number for the run of ``words`` words at each place, equal for equal runs and -1 where it holds a word 0."""
        p = 1 << (words.bit_length() - 1)
        one, two = self.rank[p][at], self.rank[p][np.minimum(at + words - p, len(self.rank[p]) - 1)]
        return np.where((one > 0) & (two > 0), one * (int(self.rank[p].max()) + 1) + two, -1)

    def order(self, at: np.ndarray) -> np.ndarray:
        """``at`` as a suffix array: by the longest runs first told apart by the shortest."""
        return at[np.lexsort([self.rank[p][at] for p in sorted(self.rank, reverse=True)])]


def _match(docs: Words, items: Words, vocabulary: np.ndarray, item_code: np.ndarray, least: int, whole: bool) -> Iterator[tuple[int, int, int, int, int]]:
    """``(text, item, words, word in text, word in item)`` of each match that can't be made longer to the left."""
    n = len(docs.hash)
    if not n or not len(item_code):
        return
    code = np.searchsorted(vocabulary, docs.hash)
    known = vocabulary[np.minimum(code, len(vocabulary) - 1)] == docs.hash
    code = np.where(known, code + 1, 0)
    # texts and items behind one another, a word 0 after each
    gap = np.arange(n) + docs.text
    far = n + int(docs.text[-1]) + 1
    item_gap = far + np.arange(len(item_code)) + items.text
    line = np.zeros(int(item_gap[-1]) + 2, np.int64)
    line[gap], line[item_gap] = code, item_code
    ends, size_of = items.last[items.text], items.last - items.first
    place = np.arange(len(item_code))
    lengths = [least] + (sorted(set(size_of[(size_of > 0) & (size_of < least)].tolist())) if whole else [])
    suffixes = Suffixes(line, max(least, min(int(size_of.max()), 64)))
    for words in lengths:
        tests = place[ends - place >= least] if words == least else items.first[size_of == words]
        found = np.flatnonzero(code > 0)
        found = found[(docs.last[docs.text[found]] - found >= words) & (suffixes.keys(gap[found], words) >= 0)]
        if not len(found) or not len(tests):
            continue
        array = suffixes.order(gap[found])  # the shard's suffix array
        keys = suffixes.keys(array, words)  # ascending along it, as its order is by words
        back = np.empty(len(line), np.int64)
        back[gap] = np.arange(n)
        wanted = suffixes.keys(item_gap[tests], words)
        if (np.diff(keys) < 0).any():
            by = np.argsort(keys, kind="stable")
            array, keys = array[by], keys[by]
        low, high = np.searchsorted(keys, wanted, side="left"), np.searchsorted(keys, wanted, side="right")
        size = high - low
        j = np.repeat(tests, size)
        i = back[array[np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]]
        inner = (i > docs.first[docs.text[i]]) & (j > items.first[items.text[j]])
        same = np.zeros(len(i), bool)
        same[inner] = code[i[inner] - 1] == item_code[j[inner] - 1]
        i, j = i[~same], j[~same]
        length = np.full(len(i), words)
        grow = np.arange(len(i))
        while len(grow):
            a, b = i[grow] + length[grow], j[grow] + length[grow]
            inside = (a < docs.last[docs.text[i[grow]]]) & (b < ends[j[grow]])
            grow, a, b = grow[inside], a[inside], b[inside]
            grow = grow[code[a] == item_code[b]]
            length[grow] += 1
        for a, b, w in zip(i.tolist(), j.tolist(), length.tolist()):
            if docs.piece(a, w) == items.piece(b, w):
                d, t = int(docs.text[a]), int(items.text[b])
                yield d, t, w, a - int(docs.first[d]), b - int(items.first[t])


def _search(shared, least: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, item_texts = shared.value
        items = Words(item_texts)
        vocabulary = np.unique(items.hash)
        item_code = np.searchsorted(vocabulary, items.hash) + 1

        def flush(ids: list, texts: list) -> pa.RecordBatch:
            hits = [(ids[d], item_ids[t], w, a, b) for d, t, w, a, b in _match(Words(texts), items, vocabulary, item_code, least, whole)]
            return pa.RecordBatch.from_arrays([pa.array([h[c] for h in hits], f.type) for c, f in enumerate(_MATCH)], schema=_MATCH)

        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                ids.append(doc)
                texts.append(text)
                size += len(text)
                if size >= SHARD:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield flush(ids, texts)

    return run


def leaked_passages(docs: DataFrame, items: DataFrame, least: int = 8, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", whole: bool = True) -> DataFrame:
    """``(doc_id, item_id, words, doc_at, item_at)``: the longest verbatim matches of at least ``least`` words and where they stand
    (word numbers from 0), compared by words in lower case.

    An item of fewer words matches as a whole (with ``whole``; else not at all). Null ids and null texts are left out, empty texts and
    items match nothing, whatever the length of a text it is searched whole; repeated documents each come out. No item gives no rows. Only the named columns are read.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), word_text(F.col(item_text)).alias("w")).filter("item_id is not null and length(w) > 0")
    size = asked.agg(F.sum(F.octet_length("w"))).first()[0] or 0
    blocks = 1 + size // ITEM_BYTES
    corpus = docs.select(F.col(doc_id).cast("long").alias("doc_id"), word_text(F.col(text)).alias("w")).filter("doc_id is not null and length(w) > 0")
    found, stash = None, Stash(spark, "leaks")
    for n in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n).collect()
        if not part:
            continue
        shared = spark.sparkContext.broadcast(([r.item_id for r in part], [r.w.encode() for r in part]))
        hits = corpus.mapInArrow(_search(shared, least, whole), "doc_id long, item_id long, words int, doc_at int, item_at int")
        if blocks > 1:  # one block's items at a time in the driver and the executors
            hits = stash.put(hits)
            shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else spark.createDataFrame([], "doc_id long, item_id long, words int, doc_at int, item_at int")


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no such passage, with all their columns; rows with a null id stay."""
    hit = leaked_passages(docs, items, doc_id=doc_id, **options).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(hit, docs[doc_id] == F.col("_leaked"), "left_anti")


def leak_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``(item_id, docs, longest)``: in how many documents an item leaks and its longest match in words."""
    return leaked_passages(docs, items, **options).groupBy("item_id").agg(F.count_distinct("doc_id").alias("docs"), F.max("words").cast("long").alias("longest"))

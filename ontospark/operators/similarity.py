"""All-pairs scores in blocks: similarity joins (J6, J7, J12), top-k (W1), counts over all pairs (A6-A9, A12-A15, A23) and
cross-attention (X6, W2, J9).

Both sides are dealt into blocks of about ``block`` rows; each pair of blocks is one group of a shuffle and one matrix product. What
leaves a group is the pairs over a threshold, the group's own top-k, or counts: scores of all pairs are rows only where ``pairs`` is asked
for them without a threshold. A table met with itself is scored on one side of the diagonal.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ontospark.operators.order import numbered
from ontospark.runtime import Stash

_OUT = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("score", pa.float64())])
_DDL = "i long, j long, score double"
#: A table is dealt into this many blocks even where fewer would do, so that a small one is not one task.
LEAST_BLOCKS = 4
#: Bins of equal width between -1 and 1 that scores are counted in for ranks; see :func:`pair_auc`.
BINS = 1 << 18
#: Scores of one bin that are small enough to be looked at one by one.
FEW = 1 << 20


class Side:
    """The rows of one block: ids, vectors, and the label of each where there is one."""

    def __init__(self, t: pa.Table):
        if not t.num_columns:  # no row at all on this side of the cogroup
            self.id, self.v, self.y = np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0, str)
            return
        t = t.combine_chunks()
        self.id = t.column("id").to_numpy()
        v = t.column("v").chunk(0) if t.num_rows else pa.array([], pa.list_(pa.float64()))
        self.v = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 0))
        self.y = t.column("y").to_numpy(zero_copy_only=False) if "y" in t.column_names else None


def usable(df: DataFrame, id_col: str, vec_col: str, label_col: str | None = None) -> tuple[DataFrame, int]:
    """``(id, v[, y])`` and its number of rows: rows without a null id, a null in the vector, NaN, or another length than the commonest
    (of equally common ones the longest)."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), *([F.col(label_col).cast("string").alias("y")] if label_col else []))
    rows = rows.filter("id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x))")
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows.filter(F.size("v") == top["d"]), top["count"]) if top else (rows, 0)


def _count(n: int, block: int) -> int:
    return max(1, -(-n // block), min(LEAST_BLOCKS, n // 128))


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    return rows.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))


def _renewed(df: DataFrame) -> DataFrame:
    """The same rows under new column identities: both sides of a cogroup must not share them."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def met_with_itself(rows: DataFrame, n: int, work: Callable[[Side, Side, bool], pa.Table], ddl: str, block: int = 2048) -> DataFrame:
    """``work(A, B, same)`` for every unordered pair of blocks; ``same`` where both are one block."""
    blocks = _count(n, block)
    dealt = _dealt(rows, blocks)
    left = dealt.select("*", F.col("blk").alias("qb"), F.explode(F.sequence(F.col("blk"), F.lit(blocks - 1))).alias("kb"))
    right = _renewed(dealt).select("*", F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("qb"), F.col("blk").alias("kb"))
    return left.drop("blk").groupBy("qb", "kb").cogroup(right.drop("blk").groupBy("qb", "kb")).applyInArrow(_guarded(work), ddl)


def _guarded(work: Callable[[Side, Side, bool], pa.Table]):
    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        return work(Side(a), Side(b), key[0] == key[1])

    return run


def block_scores(queries: DataFrame, keys: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], cut: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], block: int = 2048, ordered: bool = False) -> DataFrame:
    """``(i, j, score)``: ``kernel(Q, K)`` for every pair of blocks, of which ``cut(scores, i, j)`` says what to keep. ``ordered``: keys
    lie in blocks of exactly ``block`` rows by id."""
    q, nq = usable(queries, "id", "v")
    k, nk = usable(keys, "id", "v")
    bq, bk = _count(nq, block), max(1, -(-nk // block)) if ordered else _count(nk, block)
    k = numbered(k, "id").withColumn("blk", F.floor(F.col("pos") / block).cast("int")).drop("pos") if ordered else _dealt(k, bk)
    left = _dealt(q, bq).select("id", "v", F.col("blk").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(bk - 1))).alias("kb"))
    right = k.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(bq - 1))).alias("qb"), F.col("blk").alias("kb"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = Side(a), Side(b)
        if not len(a.id) or not len(b.id):
            return _OUT.empty_table()
        s = kernel(a.v, b.v)
        r, c = cut(s, a.id, b.id)
        return pa.table([pa.array(a.id[r]), pa.array(b.id[c]), pa.array(s[r, c])], schema=_OUT)

    return left.groupBy("qb", "kb").cogroup(right.groupBy("qb", "kb")).applyInArrow(run, _DDL)


def _dot(q: np.ndarray, k: np.ndarray) -> np.ndarray:
    return q @ k.T


def pairs(df: DataFrame, id_col: str, vec_col: str, above: float | None = None, diagonal: bool = False, block: int = 2048) -> DataFrame:
    """``(i, j, score)``: ordered pairs with score > ``above`` (strictly; None: all), without i = j unless ``diagonal``. Unusable rows
    (see :func:`usable`) are left out; a repeated id is a row of its own and doesn't pair with itself."""
    rows, n = usable(df, id_col, vec_col)

    def work(a: Side, b: Side, same: bool) -> pa.Table:
        if not len(a.id) or not len(b.id):
            return _OUT.empty_table()
        s = _dot(a.v, b.v)
        keep = np.ones(s.shape, bool) if above is None else s > above
        r, c = np.nonzero(keep if diagonal else keep & (a.id[:, None] != b.id[None, :]))
        i, j, s = a.id[r], b.id[c], s[r, c]
        if not same:
            i, j, s = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([s, s])
        return pa.table([pa.array(i), pa.array(j), pa.array(s)], schema=_OUT)

    return met_with_itself(rows, n, work, _DDL, block)


def _best_columns(s: np.ndarray, j: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` highest finite scores, ties by smaller ``j``."""
    if not s.size:
        return np.zeros(0, int), np.zeros(0, int)
    k = min(k, s.shape[1])
    floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    r, c = np.nonzero((s >= floor[:, None]) & np.isfinite(s))
    order = np.lexsort((j[c], -s[r, c], r))
    r, c = r[order], c[order]
    start = np.searchsorted(r, np.arange(len(s)))
    keep = np.arange(len(r)) - start[r] < k
    return r[keep], c[keep]


def top_k(queries: DataFrame, keys: DataFrame, id_col: str, vec_col: str, k: int = 10, skip_self: bool = True, block: int = 2048) -> DataFrame:
    """``(i, j, score, rank)``: best ``k`` keys of each query, ties by smaller key id; block-local top-k first, then the global one."""
    q, kk = (d.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")) for d in (queries, keys))

    def cut(s: np.ndarray, i: np.ndarray, j: np.ndarray):
        return _best_columns(np.where((i[:, None] == j[None, :]) & skip_self, -np.inf, s), j, k)

    order = Window.partitionBy("i").orderBy(F.col("score").desc(), "j")
    return block_scores(q, kk, _dot, cut, block).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def highest_pairs(df: DataFrame, id_col: str, vec_col: str, n: int = 20, block: int = 2048) -> DataFrame:
    """``(i, j, score)``: the ``n`` highest-scored pairs i < j of all, whatever their sign; ties by smaller i, then j (O1)."""
    rows, size = usable(df, id_col, vec_col)

    def work(a: Side, b: Side, same: bool) -> pa.Table:
        if not len(a.id) or not len(b.id):
            return _OUT.empty_table()
        s = _dot(a.v, b.v)
        # within one block each pair stands on both sides of the diagonal
        r, c = np.nonzero(a.id[:, None] < b.id[None, :] if same else a.id[:, None] != b.id[None, :])
        low, high, s = np.minimum(a.id[r], b.id[c]), np.maximum(a.id[r], b.id[c]), s[r, c]
        if len(s) > n:
            near = s >= np.partition(s, len(s) - n)[len(s) - n]
            low, high, s = low[near], high[near], s[near]
        order = np.lexsort((high, low, -s))[:n]
        return pa.table([pa.array(low[order]), pa.array(high[order]), pa.array(s[order])], schema=_OUT)

    return met_with_itself(rows, size, work, _DDL, block).orderBy(F.col("score").desc(), "i", "j").limit(n)


class PairScores:
    """Figures over the scores of all ordered pairs of a table, counted inside the blocks; labels travel with the vectors.

    ``y`` of a pair is 1 where both rows have one label. Unusable rows (see :func:`usable`) and, where labels are asked for, rows without a
    label are left out. Pairs i = j don't count unless ``diagonal``. ``shape`` maps scores before anything is counted (rounding, scaling).
    """

    def __init__(self, df: DataFrame, id_col: str, vec_col: str, label_col: str | None = None, diagonal: bool = False, block: int = 2048, shape: Callable[[np.ndarray], np.ndarray] | None = None):
        self.spark = df.sparkSession
        self.rows, self.n = usable(df.filter(F.col(label_col).isNotNull()) if label_col else df, id_col, vec_col, label_col)
        self.diagonal, self.block, self.shape = diagonal, block, shape or (lambda s: s)

    def count(self, figures: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], ddl: str) -> DataFrame:
        """The rows that ``figures(scores, y, weight)`` gives for the pairs of each two blocks; ``weight`` is 2 for pairs off the blocks'
        diagonal, which stand for both orders."""
        diagonal, shape = self.diagonal, self.shape

        def work(a: Side, b: Side, same: bool) -> pa.Table:
            s = _dot(a.v, b.v) if len(a.id) and len(b.id) else np.zeros((len(a.id), len(b.id)))
            keep = np.ones(s.shape, bool) if diagonal else a.id[:, None] != b.id[None, :]
            if a.y is None:
                y = np.zeros(s.shape, bool)
            else:
                code = np.unique(np.concatenate([a.y, b.y]).astype(str), return_inverse=True)[1]
                y = code[: len(a.id), None] == code[None, len(a.id) :]
            return pa.table(figures(shape(s[keep]), y[keep], 1 if same else 2))

        return met_with_itself(self.rows, self.n, work, ddl, self.block)

    def stats(self) -> DataFrame:
        """``(n, low, high, mean, std)`` with the population's deviation; no pair gives n = 0 and nulls."""

        def figures(s, y, w):
            m = s.mean() if len(s) else 0.0
            return {"n": [w * len(s)], "low": [s.min() if len(s) else None], "high": [s.max() if len(s) else None], "total": [w * float(s.sum())], "square": [w * float(((s - m) ** 2).sum())], "middle": [float(m)]}

        part = self.count(figures, "n long, low double, high double, total double, square double, middle double")
        whole = part.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("t"), F.sum("square").alias("q"), F.sum(F.col("n") * F.col("middle") * F.col("middle")).alias("mm"))
        mean = F.try_divide("t", "n")
        return whole.select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), "low", "high", mean.alias("mean"), F.sqrt(F.greatest(F.try_divide(F.col("q") + F.col("mm"), F.col("n")) - mean * mean, F.lit(0.0))).alias("std"))

    def passed(self, cuts: list[float]) -> DataFrame:
        """``(b, pos, neg)``: pairs by how many of the ascending ``cuts`` they lie strictly above; see ``metrics.sweep_counts``."""
        edges = np.array(sorted(set(cuts)))

        def figures(s, y, w):
            b = np.searchsorted(edges, s, side="left")
            pos, neg = (np.bincount(b[m], minlength=len(edges) + 1) * w for m in (y, ~y))
            return {"b": np.arange(len(edges) + 1, dtype=np.int32), "pos": pos.astype(np.int64), "neg": neg.astype(np.int64)}

        return self.count(figures, "b int, pos long, neg long").groupBy("b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))

    def binned(self, bins: int = BINS) -> DataFrame:
        """``(b, pos, neg)``: pairs by bins of equal width from -1 to 1; scores outside lie in the first or last bin."""

        def figures(s, y, w):
            at, where = np.unique(np.clip(np.floor((s + 1) * (bins / 2)), 0, bins - 1).astype(np.int64), return_inverse=True)
            pos, neg = (np.bincount(where[m], minlength=len(at)) * w for m in (y, ~y))
            return {"b": at, "pos": pos.astype(np.int64), "neg": neg.astype(np.int64)}

        return self.count(figures, "b long, pos long, neg long").groupBy("b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))

    def values(self, digits: int = 3) -> DataFrame:
        """``(score, n)``: pairs by rounded score."""

        def figures(s, y, w):
            v, n = np.unique(np.round(s, digits) + 0.0, return_counts=True)
            return {"score": v, "n": (n * w).astype(np.int64)}

        return self.count(figures, "score double, n long").groupBy("score").agg(F.sum("n").alias("n"))

    def histogram(self, bins: int = 50) -> DataFrame:
        """``(bin, n)``: equal-width bins between the lowest and the highest score, which belongs to the last."""
        edge = self.stats().first()
        if not edge.n:
            return self.spark.createDataFrame([], "bin long, n long")
        lo, hi = edge.low, edge.high

        def figures(s, y, w):
            b = np.minimum(np.floor((s - lo) / (hi - lo) * bins), bins - 1).astype(np.int64) if hi > lo else np.zeros(len(s), np.int64)
            n = np.bincount(b, minlength=bins) * w
            at = np.flatnonzero(n)
            return {"bin": at.astype(np.int64), "n": n[at].astype(np.int64)}

        return self.count(figures, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))

    def losses(self) -> DataFrame:
        """``(loss, n1, n0)``: class means of -log p and -log(1-p), each divided by its class count again; logs end at -100."""

        def figures(p, y, w):
            with np.errstate(divide="ignore", invalid="ignore"):
                one, zero = -np.maximum(np.log(p[y]), -100.0), -np.maximum(np.log(1 - p[~y]), -100.0)
            return {"a": [w * float(one.sum())], "b": [w * float(zero.sum())], "n1": [w * int(y.sum())], "n0": [w * int((~y).sum())]}

        t = self.count(figures, "a double, b double, n1 long, n0 long").agg(*[F.sum(c).alias(c) for c in ("a", "b", "n1", "n0")]).fillna(0)
        share = lambda a, n: F.coalesce(F.try_divide(F.try_divide(a, n), F.col(n)), F.lit(0.0))
        return t.select((share("a", "n1") + share("b", "n0")).alias("loss"), "n1", "n0")

    def above(self, cut: float) -> DataFrame:
        """``(i, n)``: how many pairs of each row lie strictly above ``cut``, rows without any left out."""

        def work(a: Side, b: Side, same: bool) -> pa.Table:
            s = _dot(a.v, b.v) > cut if len(a.id) and len(b.id) else np.zeros((len(a.id), len(b.id)), bool)
            s &= a.id[:, None] != b.id[None, :]
            i, n = (a.id, s.sum(1)) if same else (np.concatenate([a.id, b.id]), np.concatenate([s.sum(1), s.sum(0)]))
            return pa.table({"i": i[n > 0], "n": n[n > 0].astype(np.int64)})

        return met_with_itself(self.rows, self.n, work, "i long, n long", self.block).groupBy("i").agg(F.sum("n").alias("n"))

    def _between(self, low: float, high: float) -> np.ndarray:
        """All scores in [low, high), each as often as it occurs."""

        def figures(s, y, w):
            v = s[(s >= low) & (s < high)]
            return {"score": np.repeat(v, w)}

        return np.sort(self.count(figures, "score double").toArrow().column(0).to_numpy())

    def percentile(self, share: float, bins: int = 1 << 16) -> float | None:
        """The score at ``share`` of all scores in order, between two of them by straight line (A23); no pair gives None.

        Scores are counted in bins; only those of the bins that hold the two wanted ones are looked at, after these have been cut again as
        often as it takes to hold at most ``FEW``. More equal scores than that in one spot are told by their count alone.
        """
        edge = self.stats().first()
        if not edge.n:
            return None
        at = (edge.n - 1) * share
        first = int(np.floor(at))
        found = self._nth([first, min(first + 1, edge.n - 1)], edge.low, np.nextafter(edge.high, np.inf), bins)
        a, b = found[first], found[min(first + 1, edge.n - 1)]
        return float(a + (at - first) * (b - a))

    def _nth(self, wanted: list[int], low: float, high: float, bins: int) -> dict[int, float]:
        """The scores with so many others before them, of all scores; they lie in [low, high)."""
        edges = np.linspace(low, high, bins + 1)
        if edges[1] <= edges[0] or high - low <= 4 * np.spacing(max(abs(low), abs(high))):
            return dict.fromkeys(wanted, float(low))

        def figures(s, y, w):
            at, n = np.unique(np.searchsorted(edges, s, side="right"), return_counts=True)
            return {"b": at.astype(np.int64), "n": (n * w).astype(np.int64)}

        # scores before ``low`` lie in bin 0, so that places are those among all scores
        got = self.count(figures, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).orderBy("b").toArrow()
        b, upto = got.column("b").to_numpy(), np.cumsum(got.column("n").to_numpy())
        found, place = {}, np.searchsorted(upto, wanted, side="right")
        for x in np.unique(place):
            own = [k for k, p in zip(wanted, place) if p == x]
            begin, end, before = float(edges[b[x] - 1]), float(edges[b[x]]), int(upto[x - 1]) if x else 0
            if upto[x] - before > FEW:
                found |= self._nth(own, begin, end, bins)
            else:
                values = self._between(begin, end)
                found |= {k: float(values[k - before]) for k in own}
        return found


def pair_auc(scores: PairScores, bins: int = BINS) -> DataFrame:
    """``(auc, pos, neg)`` of pair scores, those of one bin counting as ties; one class only gives 0.

    The error against exact ranks is below half the share of (positive, negative) pairs that share a bin, which for smooth scores is
    about ``1 / bins``, and mostly cancels. At most ``bins`` counts leave the blocks, whatever the number of pairs.
    """
    from ontospark.operators.metrics import auc_of_counts

    return auc_of_counts(scores.binned(bins).select(F.col("b").alias("s"), F.col("pos").alias("p"), F.col("neg").alias("n")))


def _head_scores(q: np.ndarray, k: np.ndarray, heads: int, eps: float, w_query, w_key):
    q, k = (x / np.sqrt((x * x).mean(1, keepdims=True) + eps) for x in (q, k))
    q, k = (q if w_query is None else q @ w_query.T), (k if w_key is None else k @ w_key.T)
    d = q.shape[1] // heads
    for h in range(heads):
        yield h, q[:, h * d : (h + 1) * d] @ k[:, h * d : (h + 1) * d].T * d**-0.5


def attention(df: DataFrame, id_col: str, vec_col: str, heads: int = 4, key_block: int | None = 64, above: float = 0.0, eps: float = 1e-6, w_query: np.ndarray | None = None, w_key: np.ndarray | None = None) -> DataFrame:
    """``(i, j, score)`` of a query/key head: RMS-normalised vectors, per-head scaled products, softmax over the keys of one block
    (blocks of ``key_block`` rows in id order; None: over all keys), averaged over heads; scores strictly over ``above``. Unusable rows
    (see :func:`usable`) are left out."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    if key_block is None:
        return _global_attention(rows, heads, above, eps, w_query, w_key)

    def kernel(q: np.ndarray, k: np.ndarray) -> np.ndarray:
        total = np.zeros((len(q), len(k)))
        for _, s in _head_scores(q, k, heads, eps, w_query, w_key):
            e = np.exp(s - s.max(1, keepdims=True))
            total += e / e.sum(1, keepdims=True)
        return total / heads

    return block_scores(rows, rows, kernel, lambda s, i, j: np.nonzero(s > above), key_block, ordered=True)


def _global_attention(rows: DataFrame, heads: int, above: float, eps: float, w_query, w_key, block: int = 2048) -> DataFrame:
    """Softmax over all keys in two passes: the first leaves each query's log-sum-exp per head and block of keys, the second scores."""
    ready, n = usable(rows, "id", "v")
    blocks = _count(n, block)
    dealt = _dealt(ready, blocks)
    right = _renewed(dealt).select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qb"), F.col("blk").alias("kb"))
    ways = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("kb")
    sums = pa.schema([("id", pa.int64()), ("top", pa.list_(pa.float64())), ("total", pa.list_(pa.float64()))])

    def first(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = Side(a), Side(b)
        if not len(a.id) or not len(b.id):
            return sums.empty_table()
        top, total = np.zeros((len(a.id), heads)), np.zeros((len(a.id), heads))
        for h, s in _head_scores(a.v, b.v, heads, eps, w_query, w_key):
            top[:, h] = s.max(1)
            total[:, h] = np.exp(s - top[:, h : h + 1]).sum(1)
        return pa.table([pa.array(a.id), pa.array(list(top)), pa.array(list(total))], schema=sums)

    part = dealt.select("id", "v", F.col("blk").alias("qb"), ways).groupBy("qb", "kb").cogroup(right.groupBy("qb", "kb")).applyInArrow(first, "id long, top array<double>, total array<double>")
    each = part.select("id", F.posexplode(F.arrays_zip("top", "total")).alias("h", "s")).select("id", "h", F.col("s.top").alias("top"), F.col("s.total").alias("total"))
    most = each.groupBy("id", "h").agg(F.collect_list(F.struct("top", "total")).alias("s")).withColumn("m", F.array_max(F.transform("s", lambda x: x["top"])))
    norm = F.col("m") + F.log(F.aggregate("s", F.lit(0.0), lambda t, x: t + x["total"] * F.exp(x["top"] - F.col("m"))))
    lse = most.select("id", "h", norm.alias("z")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "z"))), lambda x: x["z"]).alias("z"))
    lse = Stash(rows.sparkSession, "attention").put(lse)  # written, so that the first pass runs once

    def second(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _OUT.empty_table()
        z = a.combine_chunks().column("z")
        a, b = Side(a), Side(b)
        z = z.chunk(0).flatten().to_numpy().reshape(len(a.id), heads)
        score = sum(np.exp(s - z[:, h : h + 1]) for h, s in _head_scores(a.v, b.v, heads, eps, w_query, w_key)) / heads
        r, c = np.nonzero(score > above)
        return pa.table([pa.array(a.id[r]), pa.array(b.id[c]), pa.array(score[r, c])], schema=_OUT)

    asked = dealt.select("id", "v", F.col("blk").alias("qb"), ways).join(lse, "id").select("id", "v", "z", "qb", "kb")
    return asked.groupBy("qb", "kb").cogroup(right.groupBy("qb", "kb")).applyInArrow(second, _DDL)

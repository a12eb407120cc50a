"""Problem 1: the most similar vectors of every vector, by score-aware (anisotropic) four-bit codes and exact reranking.

The index is fitted on a bounded sample (``SAMPLE`` rows: centroids and codebooks) and holds every usable row: a coarse centroid, whose cell
it lies in, a four-bit code of the residual and the packed vector. Cells are counted first, over all rows, and full ones divided round their
own mean, so that no task gets more than a bounded one. Candidates come from scans of four-bit tables (two neighbouring ones
read as one of 256 entries) inside cells (self join) or over all rows (a stated query set); every score that comes out is an exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ontospark.llm.vectors import AnisotropicCodes, near_axes, nibbles, pack, rotation, spherical_kmeans, unit, unpack, usable_rows
from ontospark.runtime import Stash

#: Rows that the centroids are fitted on, and those of them (the first in hash order) for the codebooks, of whatever number there are.
SAMPLE, BOOK_SAMPLE = 12_000, 4_000
#: Rows that a centroid stands for, up to MOST centroids: its cell is scanned whole. A row is also put under its second centroid within
#: MARGIN.
CELL_ROWS, MOST, MARGIN = 1 << 14, 1024, 0.04
#: A cell of more rows is divided by axes round its own mean, before the shuffle, up to DEEPEST times, so that no task gets an unbounded one;
#: there a row also lies in adjacent parts within RATIO of its strongest axis, SPILL at most.
FULL, DEEPEST, RATIO, SPILL = 1 << 15, 5, 0.8, 4
#: Pairs that a task holds before it cuts its lists.
HELD = 1 << 21
#: Bytes of one copied row, and of the rows that one task gets.
ROW_BYTES, TASK_BYTES = 340, 8 << 20
#: Queries that one pass over the index takes, and rows of the index that are scanned together.
BLOCK, PART = 32_768, 1 << 17

_ROW = pa.schema([("cell", pa.int64()), ("id", pa.int64()), ("code", pa.binary()), ("vec", pa.binary())])
_PAIR = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("cosine", pa.float64())])


class Index:
    """What the sample taught: centroids, codebooks, and how far below the true score a table sum may lie."""

    def __init__(self, sample: np.ndarray, rows: int, dim: int, seed: int):
        self.dim, self.seed = dim, seed
        x = unit(sample).astype(np.float32) if len(sample) else np.eye(1, dim, dtype=np.float32)
        self.centroids = spherical_kmeans(x, int(min(MOST, max(1, rows // CELL_ROWS))), seed, 6)
        small = x[:BOOK_SAMPLE]
        self.codes = AnisotropicCodes(seed=seed).fit(small, self.centroids[(small @ self.centroids.T).argmax(1)])
        self._small = small

    def slack(self, least: float) -> float:
        """Largest shortfall of the table sum over the sample, for queries at exactly cosine ``least``."""
        x = self._small
        base = self.centroids[(x @ self.centroids.T).argmax(1)]
        near = base + self.codes.decode(self.codes.encode(x, base, 1))
        g = np.random.default_rng(self.seed).standard_normal(x.shape).astype(np.float32)
        g -= (g * x).sum(1, keepdims=True) * x
        g /= np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-9)
        q = least * x + np.sqrt(max(0.0, 1 - least * least)) * g
        return float(max(0.01, 1.1 * (least - (q * near).sum(1)).max()))

    def code(self, x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        return nibbles(self.codes.encode(x, self.centroids[centroid], 1))


def _source(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("embedding")).filter("id is not null and embedding is not null")


def fit_index(source: DataFrame, dim: int, seed: int = 5) -> Index:
    """Fits on at most ``SAMPLE`` rows, drawn by a hash of the id."""
    rows = source.count()
    part = source.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < min(1_000_000, int(1.2e6 * SAMPLE / max(1, rows)) + 1))
    column = part.limit(SAMPLE).select("embedding").toArrow().column(0)
    x = usable_rows(column.combine_chunks(), dim)[1] if len(column) else np.zeros((0, dim), np.float32)
    return Index(x, rows, dim, seed)


def _placed(i: Index, x: np.ndarray, split: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, centroids and cells of unit rows: all that a row lies in or near; ``split`` has the means of cells that are divided."""
    score = x @ i.centroids.T
    first = score.argmax(1)
    ways = [(np.arange(len(x)), first)]
    if score.shape[1] > 1:
        top = score[np.arange(len(x)), first].copy()
        score[np.arange(len(x)), first] = -9
        second = score.argmax(1)
        close = np.flatnonzero(top - score[np.arange(len(x)), second] < MARGIN)
        ways.append((close, second[close]))
    for rows, centroid in ways:
        if not len(rows):
            continue
        row, cell = rows, centroid.astype(np.int64)
        for depth in range(DEEPEST if split else 0):
            row, cell = _divided(i, x, row, cell, split, depth)
        yield row, cell % (1 << 20), cell


def _divided(i: Index, x: np.ndarray, row: np.ndarray, cell: np.ndarray, split: dict[int, np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of divided cells in the parts of one level: the strongest axes of another rotation round the cell's mean."""
    rows, cells = [], []
    for c in np.unique(cell):
        at = np.flatnonzero(cell == c)
        mean = split.get(int(c)) if int(c) >> 20 >> (8 * depth) == 0 else None
        if mean is None:
            rows.append(row[at]), cells.append(cell[at])
            continue
        where, axis = near_axes(x[row[at]] - mean, rotation(i.dim, i.seed + 51 + depth)[:, :127], RATIO, min(SPILL, i.dim))
        rows.append(row[at][where]), cells.append(c + ((axis.astype(np.int64) + 1) << (20 + 8 * depth)))
    return np.concatenate(rows), np.concatenate(cells)


_CELL = pa.schema([("cell", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.float64()))])


def _count_rows(index, split, means: bool):
    """Copies of each cell, or the number and vector sum of those that are to be divided; summed in the task before they leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, known = index.value, split.value
        done, asked = {c: m for c, m in known.items() if m is not None}, np.array([c for c, m in known.items() if m is None], np.int64)
        cells, counts, totals = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, i.dim if means else 0))
        for b in batches:
            _, raw = usable_rows(b.column(1), i.dim)
            if not len(raw):
                continue
            x = unit(raw).astype(np.float32)
            for row, _, cell in _placed(i, x, done):
                if means:
                    own = np.isin(cell, asked)
                    row, cell = row[own], cell[own]
                c, where = np.unique(np.concatenate([cells, cell]), return_inverse=True)
                n = np.bincount(where, np.concatenate([counts, np.ones(len(cell), np.int64)]), len(c)).astype(np.int64)
                total = np.zeros((len(c), totals.shape[1]))
                if means:
                    total[where[: len(cells)]] = totals
                    np.add.at(total, where[len(cells) :], x[row])
                cells, counts, totals = c, n, total
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts), pa.array(list(totals), pa.list_(pa.float64()))], schema=_CELL)

    return run


_CELL_DDL = "cell long, n long, total array<double>"


def _divide(rows: DataFrame, index) -> tuple[dict[int, np.ndarray], int]:
    """Means of the cells that hold more than ``FULL`` rows, level by level (at most copies / FULL of them), and the number of copies."""
    sc, split, copies = rows.sparkSession.sparkContext, {}, 0
    for _ in range(DEEPEST):
        counts = rows.mapInArrow(_count_rows(index, sc.broadcast(split), False), _CELL_DDL).groupBy("cell").agg(F.sum("n").alias("n"))
        total = counts.agg(F.sum("n").alias("all"), F.collect_list(F.when(F.col("n") > FULL, F.col("cell"))).alias("full")).first()
        copies = total["all"] or 0
        full = [c for c in total["full"] if c not in split]
        if not full:
            break
        part = rows.mapInArrow(_count_rows(index, sc.broadcast(split | dict.fromkeys(full)), True), _CELL_DDL)
        long = part.select("cell", "n", F.posexplode("total").alias("dim", "x")).groupBy("cell", "dim").agg((F.sum("x") / F.sum("n")).alias("x"))
        for r in long.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda v: v["x"]).alias("mean")).collect():
            split[r["cell"]] = np.array(r["mean"], np.float32)
    return split, copies


def _index_rows(index, spilled: bool, split=None):
    """Index entries of usable rows: one each for a full scan, or one for every cell that a row lies in or near."""
    ix, dim = index, index.value.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = ix.value
        for b in batches:
            mask, raw = usable_rows(b.column(1), dim)
            if not len(raw):
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)[mask]
            x, vec = unit(raw).astype(np.float32), pack(raw)
            if spilled:
                ways = _placed(i, x, split.value)
            else:
                first = (x @ i.centroids.T).argmax(1)
                ways = [(np.arange(len(x)), first, first.astype(np.int64))]
            for row, centroid, cell in ways:
                # one code for each row and centroid, whatever the number of cells
                pair, where = np.unique(row * len(i.centroids) + centroid, return_inverse=True)
                code = np.ascontiguousarray(i.code(x[pair // len(i.centroids)], pair % len(i.centroids)))
                width = code.shape[1]
                packed = pa.Array.from_buffers(pa.binary(), len(pair), [None, pa.py_buffer((np.arange(len(pair) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(code.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(ids[row]), packed.take(pa.array(where)), vec.take(pa.array(row))], schema=_ROW)

    return run


def _fixed(column: pa.Array) -> np.ndarray:
    buf, n = column.buffers(), len(column)
    offsets = np.frombuffer(buf[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(buf[2], np.uint8)[offsets[0] : offsets[-1]].reshape(n, -1)


def _best(q: np.ndarray, near: np.ndarray, cosine: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's ``k`` highest scores, ties by smaller id."""
    order = np.lexsort((near, -cosine, q))
    start = np.flatnonzero(np.diff(q[order], prepend=q[order][0] - 1)) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < k]


def _shortest(parts: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists ``(row, near, cosine)`` as one, each pair once, cut to each row's ``k`` best."""
    q, near, cosine = (np.concatenate([p[j] for p in parts]) for j in range(3))
    order = np.lexsort((near, q))
    q, near, cosine = q[order], near[order], cosine[order]
    once = np.ones(len(q), bool)
    once[1:] = (q[1:] != q[:-1]) | (near[1:] != near[:-1])
    q, near, cosine = q[once], near[once], cosine[once]
    keep = _best(q, near, cosine, k)
    return q[keep], near[keep], cosine[keep]


def _scan_cell(index, k: int, least: float, slack: float):
    ix = index

    def run(t: pa.Table) -> pa.Table:
        i, t = ix.value, t.combine_chunks()
        ids = t.column("id").to_numpy()
        if len(ids) < 2:
            return _PAIR.empty_table()
        exact = unit(unpack(t.column("vec").chunk(0), i.dim))
        x = exact.astype(np.float32)
        code = _fixed(t.column("code").chunk(0))
        base = x @ i.centroids[t.column("cell")[0].as_py() % (1 << 20)]
        lists, parts, held = (ids[:0], ids[:0], np.zeros(0)), [], 0
        for at in range(0, len(ids) - 1, 64):
            tables, scale = i.codes.byte_tables(x[at : at + 64])
            least_sum = np.clip(np.floor((least - slack - base[at : at + 64]) * scale), -32768, 32767).astype(np.int16)
            for low in range(at, len(ids), 2048):
                hit = i.codes.scan(tables, code[low : low + 2048]) >= least_sum
                r, c = np.divmod(np.flatnonzero(hit), hit.shape[1])
                if len(r) > hit.size // 50:  # a dense cell: one product, and of each row and query only what its own list can take
                    score = np.where(hit, exact[low : low + 2048] @ exact[at : at + 64].T, -2.0)
                    most = [np.partition(score, n - min(k + 1, n), axis=d).take([n - min(k + 1, n)], axis=d) for d, n in ((0, len(score)), (1, score.shape[1]))]
                    r, c = np.nonzero((score >= least) & ((score >= most[0]) | (score >= most[1])))
                    score = score[r, c]
                else:
                    score = np.einsum("nd,nd->n", exact[low + r], exact[at + c])
                keep = (score >= least) & (r + low > c + at) & (ids[low + r] != ids[at + c])
                if keep.any():
                    a, b, s = ids[at + c[keep]], ids[low + r[keep]], score[keep]
                    parts += [(a, b, s), (b, a, s)]
                    held += 2 * len(a)
                if held > HELD:
                    lists, parts, held = _shortest([lists, *parts], k), [], 0
        return pa.table([pa.array(v) for v in _shortest([lists, *parts], k)], schema=_PAIR)

    return run


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "near")
    return pairs.groupBy("id", "near").agg(F.max("cosine").alias("cosine")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def near_neighbours(df: DataFrame, id_col: str = "id", vector_col: str = "embedding", k: int = 5, least: float = 0.96, dim: int = 128, seed: int = 5) -> DataFrame:
    """``(id, near, cosine, rank)``: for every usable vector its up to ``k`` most similar others with cosine >= ``least``.

    Usable: ``dim`` finite values, not all zero; rows with a null id are left out; vectors need not be of unit length. Ties go to the
    smaller id. Bit-equal vectors are collapsed before the search and their lists restored after it, so a group of copies of any
    size costs one entry. A row repeated with its id never pairs with itself. Only the two named columns are read.
    """
    spark, source = df.sparkSession, _source(df, id_col, vector_col)
    index = fit_index(source, dim, seed)
    slack, shared = index.slack(least), spark.sparkContext.broadcast(index)
    stash = Stash(spark, "neighbours")
    # copies: two hashes of the whole array, computed without leaving the JVM
    low, high, inf = F.array_min("embedding"), F.array_max("embedding"), F.lit(float("inf"))
    good = (F.size("embedding") == dim) & (F.size(F.array_compact("embedding")) == dim) & (high < inf) & (low > -inf) & ((high > 0) | (low < 0))
    keyed = source.filter(good).select("id", F.xxhash64("embedding").alias("h"), F.hash("embedding").alias("g"))
    groups = stash.put(keyed.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1").select("h", "g", "rep"))
    copied = groups.limit(1).count() > 0
    rows = source
    if copied:
        member = stash.put(keyed.join(groups, ["h", "g"]).select("id", "rep").distinct())
        rows = source.join(member.filter("id <> rep").select("id"), "id", "left_anti")
    split, copies = _divide(rows, shared)
    cells = rows.mapInArrow(_index_rows(shared, True, spark.sparkContext.broadcast(split)), "cell long, id long, code binary, vec binary")
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-copies * ROW_BYTES // TASK_BYTES))
    pairs = cells.repartition(tasks, "cell").groupBy("cell").applyInArrow(_scan_cell(shared, k, least, slack), "id long, near long, cosine double")
    if copied:
        order = Window.partitionBy("rep").orderBy("id")
        first = member.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).select("rep", F.col("id").alias("copy"))
        spread = pairs.join(first, F.col("near") == F.col("rep"), "left").select("id", F.coalesce("copy", "near").alias("near"), "cosine")
        own = first.select(F.col("rep").alias("id"), F.col("copy").alias("near"), F.lit(1.0).alias("cosine"))
        # k + 1, as a group's list holds its own members too
        lists = _ranked(spread.unionByName(own), k + 1).select(F.col("id").alias("rep"), "near", "cosine")
        # the members of a large group stand on the side that a skewed join can split
        several = member.join(lists, "rep").select("id", "near", "cosine").filter("id <> near")
        pairs = lists.join(groups.select("rep").distinct(), "rep", "left_anti").select(F.col("rep").alias("id"), "near", "cosine").unionByName(several)
    return _ranked(pairs, k)


def similar_pairs(df: DataFrame, **options) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: pairs of which at least one is on the list of the other; see :func:`near_neighbours`."""
    lists = near_neighbours(df, **options)
    return lists.select(F.least("id", "near").alias("id_a"), F.greatest("id", "near").alias("id_b")).distinct()


def _scan_all(index, block, k: int, over: int):
    """Scans the four-bit codes of every row for each query of the block, reranks the best ``over * k`` exactly, keeps ``k``."""
    ix, queries = index, block

    def flush(i: Index, parts: list) -> pa.RecordBatch | None:
        qid, qraw = queries.value
        ids = np.concatenate([p[0] for p in parts])
        code, raw, cent = (np.concatenate([p[j] for p in parts]) for j in (1, 2, 3))
        length = np.linalg.norm(raw.astype(np.float64), axis=1)
        out = []
        for at in range(0, len(qid), 64):
            q = unit(qraw[at : at + 64])
            q32 = q.astype(np.float32)
            tables, scale = i.codes.byte_tables(q32, room=1.0)
            base = np.rint((q32 @ i.centroids.T).T * scale).astype(np.int16)
            want = min(len(ids), over * k + 1)
            floor = np.full(len(q), np.iinfo(np.int16).min, np.int16)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for low in range(0, len(ids), 2048):
                sums = i.codes.scan(tables, code[low : low + 2048])
                sums += base[cent[low : low + 2048]]
                if low == 0:
                    floor = np.partition(sums, max(0, len(sums) - want), axis=0)[max(0, len(sums) - want)]
                r, c = np.divmod(np.flatnonzero(sums >= floor), len(q))
                found.append((r + low, c, sums[r, c]))
                if low and sum(len(f[0]) for f in found) > 4 * want * len(q):
                    found, floor = _trim(found, want, len(q))
            found, _ = _trim(found, want, len(q))
            r, c, _ = found[0]
            exact = np.einsum("nd,nd->n", raw[r].astype(np.float64), q[c]) / length[r] if len(r) else np.zeros(0)
            other = ids[r] != qid[at + c]
            r, c, exact = r[other], c[other], exact[other]
            best = _best(c, ids[r], exact, k)
            out.append((qid[at + c[best]], ids[r[best]], exact[best]))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[j] for o in out])) for j in range(3)], schema=_PAIR)

    def _trim(found, want, n):
        r, c, s = (np.concatenate([f[j] for f in found]) for j in range(3))
        keep = _best(c, r, s.astype(np.int32), want)
        r, c, s = r[keep], c[keep], s[keep]
        floor = np.full(n, np.iinfo(np.int16).min, np.int16)
        low = np.full(n, np.iinfo(np.int16).max, np.int16)
        np.minimum.at(low, c, s)
        full = np.bincount(c, minlength=n) >= want
        floor[full] = low[full]
        return [(r, c, s)], floor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, parts, n = ix.value, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            parts.append((b.column(1).to_numpy(), _fixed(b.column(2)), unpack(b.column(3), i.dim), b.column(0).to_numpy()))
            n += b.num_rows
            if n >= PART:
                yield flush(i, parts)
                parts, n = [], 0
        if parts and (last := flush(i, parts)) is not None:
            yield last

    return run


def nearest(df: DataFrame, query_filter: str = "id % 20 = 0", id_col: str = "id", vector_col: str = "embedding", k: int = 10, over: int = 10, dim: int = 128, seed: int = 5) -> DataFrame:
    """``(id, rank, near, cosine)``: the ``k`` most similar rows, of all rows, for each usable row that meets ``query_filter``.

    The stated queries are taken in blocks of at most ``BLOCK`` (a bounded broadcast, collected block by block); each block scans
    the four-bit codes of all rows. Unusable vectors and null ids are left out on both sides, a query is never its own neighbour,
    ties go to the smaller id, no query gives no rows. Cosines are exact; the search misses only what the codes rank below
    ``over * k``.
    """
    spark, source = df.sparkSession, _source(df, id_col, vector_col)
    index = fit_index(source, dim, seed)
    shared = spark.sparkContext.broadcast(index)
    stash = Stash(spark, "nearest")
    rows = stash.put(source.dropDuplicates(["id"]).mapInArrow(_index_rows(shared, False), "cell long, id long, code binary, vec binary"))
    asked = rows.filter(query_filter).select("id", "vec")
    blocks = 1 + int(1.1 * asked.count()) // BLOCK
    lists = []
    for n in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).toArrow().combine_chunks()
        if part.num_rows:
            block = spark.sparkContext.broadcast((part.column("id").to_numpy(), unpack(part.column("vec").chunk(0), dim)))
            found = rows.mapInArrow(_scan_all(shared, block, k, over), "id long, near long, cosine double")
            if blocks > 1:  # one block's queries at a time in the driver and the executors
                found = stash.put(found)
                block.destroy()
            lists.append(found)
    if not lists:
        return spark.createDataFrame([], "id long, rank int, near long, cosine double")
    found = lists[0]
    for more in lists[1:]:
        found = found.unionByName(more)
    return _ranked(found, k).select("id", "rank", "near", "cosine")

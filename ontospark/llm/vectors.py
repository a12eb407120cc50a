"""NumPy kernels shared by the vector operators: packing, rotated-axis cells, anisotropic 4-bit codes.

They run inside Arrow batches on the executors (or on a bounded sample on the driver) and know nothing of Spark.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa


def usable_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row mask and float32 matrix of the usable vectors (``dim`` finite values, not all zero) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    offsets = column.offsets.to_numpy(zero_copy_only=False)
    values = column.values.to_numpy(zero_copy_only=False)
    mask = np.diff(offsets) == dim
    if column.null_count:
        mask &= ~np.asarray(column.is_null())
    rows = np.flatnonzero(mask)
    x = values[offsets[:-1][rows][:, None] + np.arange(dim)].astype(np.float32) if len(rows) else np.zeros((0, dim), np.float32)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    mask = np.zeros(n, bool)
    mask[rows[good]] = True
    return mask, x[good]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in float64 (scaled by the largest entry first, so nothing over- or underflows)."""
    y = x.astype(np.float64)
    y /= np.abs(y).max(1, keepdims=True)
    return y / np.sqrt((y * y).sum(1, keepdims=True))


def pack(x: np.ndarray) -> pa.Array:
    """Lossless bytes of each row: float16 where every value survives it, float32 otherwise."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    exact = (half.astype(np.float32) == x).all(1)
    size = np.where(exact, half.itemsize, x.itemsize) * x.shape[1]
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = np.empty(offsets[-1], np.uint8)
    for rows, part in ((np.flatnonzero(exact), half), (np.flatnonzero(~exact), x.astype(np.float32))):
        if len(rows):
            width = part.itemsize * part.shape[1]
            data[offsets[rows][:, None] + np.arange(width)] = np.ascontiguousarray(part[rows]).view(np.uint8).reshape(len(rows), width)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    """Float32 matrix back from :func:`pack`."""
    buf = column.buffers()
    offsets = np.frombuffer(buf[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buf[2], np.uint8)
    size = np.diff(offsets)
    out = np.empty((len(column), dim), np.float32)
    for width, kind in ((2 * dim, np.float16), (4 * dim, np.float32)):
        rows = np.flatnonzero(size == width)
        if len(rows):
            out[rows] = data[offsets[:-1][rows][:, None] + np.arange(width)].view(kind)
    return out


@lru_cache(maxsize=64)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix (QR of a Gaussian one), equal on every worker for a seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def strongest_axes(y: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` signed axes on which each rotated row is strongest, in no order: a row's cell and the adjacent ones it nearly fell
    into."""
    top = np.argpartition(-np.abs(y), most - 1, axis=1)[:, :most]
    return (2 * top + (np.take_along_axis(y, top, 1) < 0)).astype(np.int64)


def spherical_kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit rows; empty clusters are dropped."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros((len(c), x.shape[1]), np.float64)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        c = (total[norm > 1e-9] / norm[norm > 1e-9, None]).astype(np.float32)
    return c


class AnisotropicCodes:
    """Four-bit product codes of residuals whose loss weighs the error parallel to the vector more.

    For a unit vector ``x`` with code ``y`` the loss is ``|x-y|^2 + (eta-1) <x-y, x>^2``, ``eta = (d-1) t^2/(1-t^2)``: errors along
    ``x`` move high inner products, errors across it hardly do. Codebooks (16 entries for each ``width`` dimensions) and
    assignments are found by coordinate descent, each step exact given the others.
    """

    def __init__(self, width: int = 2, threshold: float = 0.35, rounds: int = 1, seed: int = 7):
        self.width, self.threshold, self.rounds, self.seed = width, threshold, rounds, seed
        self.books = np.zeros((0, 16, width), np.float32)

    def _eta(self, dim: int) -> float:
        return max(1.0, (dim - 1) * self.threshold**2 / (1 - self.threshold**2))

    def fit(self, x: np.ndarray, base: np.ndarray) -> AnisotropicCodes:
        """Codebooks from unit rows ``x`` and the centroids ``base`` whose residuals are coded."""
        n, dim = x.shape
        m, w = dim // self.width, self.width
        r, d = (x - base).reshape(n, m, w), x.reshape(n, m, w)
        rng = np.random.default_rng(self.seed)
        self.books = np.stack([r[rng.choice(n, 16, replace=n < 16), j] for j in range(m)]).astype(np.float32)
        eta = self._eta(dim)
        for step in range(self.rounds + 4):
            codes = self.encode(x, base, sweeps=0 if step < 4 else 1)
            error = r - self.books[np.arange(m), codes]
            parallel = (error * d).sum((1, 2))
            for j in range(m):
                rest = parallel - (error[:, j] * d[:, j]).sum(1)
                target = rest + (r[:, j] * d[:, j]).sum(1)
                for c in np.unique(codes[:, j]):
                    own = codes[:, j] == c
                    dx = d[own, j]
                    a = own.sum() * np.eye(w) + (eta - 1) * dx.T @ dx
                    self.books[j, c] = np.linalg.solve(a, r[own, j].sum(0) + (eta - 1) * dx.T @ target[own])
                error[:, j] = r[:, j] - self.books[j, codes[:, j]]
                parallel = rest + (error[:, j] * d[:, j]).sum(1)
        return self

    def encode(self, x: np.ndarray, base: np.ndarray, sweeps: int = 2, chunk: int = 1024) -> np.ndarray:
        """Codes 0..15, one column per subspace."""
        n, dim = x.shape
        m, w = dim // self.width, self.width
        out = np.empty((n, m), np.int64)
        weight, turned = self._eta(dim) - 1, self.books.transpose(0, 2, 1)
        for start in range(0, n, chunk):
            d = x[start : start + chunk].reshape(-1, m, w).transpose(1, 0, 2)
            r = (x[start : start + chunk] - base[start : start + chunk]).reshape(-1, m, w).transpose(1, 0, 2)
            rows = np.arange(d.shape[1])
            across = (self.books**2).sum(2)[:, None, :] - 2 * (r @ turned)
            codes = across.argmin(2)
            if sweeps:
                along = (r * d).sum(2)[:, :, None] - d @ turned
                now = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0]
                total = now.sum(0)
                for _ in range(sweeps):
                    for j in range(m):
                        rest = total - now[j]
                        codes[j] = (across[j] + weight * (rest[:, None] + along[j]) ** 2).argmin(1)
                        now[j] = along[j][rows, codes[j]]
                        total = rest + now[j]
            out[start : start + chunk] = codes.T
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """The 16 partial products of every subspace with each query: (subspace, entry, query)."""
        q = queries.reshape(len(queries), -1, self.width)
        return np.einsum("nmw,mcw->mcn", q, self.books, optimize=True).astype(np.float32)

    def byte_tables(self, queries: np.ndarray, room: float = 0.0) -> tuple[np.ndarray, float]:
        """For long scans: the tables of two neighbouring subspaces as one of 256 entries, in 16-bit integers, and their scale. ``room``:
        how much may be added to a sum."""
        t = self.tables(queries).astype(np.float32)
        both = t[1::2, :, None, :] + t[::2, None, :, :]
        scale = 30000.0 / max(1e-9, float(np.abs(both).max(1).max(1).sum(0).max()) + room)
        return np.rint(both.reshape(len(both), 256, -1) * scale).astype(np.int16), scale

    @staticmethod
    def scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products (row, query): one table row per four-bit code, summed over the subspaces."""
        total = tables[0].take(codes[:, 0], axis=0)
        for j in range(1, len(tables)):
            total += tables[j].take(codes[:, j], axis=0)
        return total


def nibbles(codes: np.ndarray) -> np.ndarray:
    """Two codes to a byte."""
    return (codes[:, ::2] | (codes[:, 1::2] << 4)).astype(np.uint8)


def from_nibbles(packed: np.ndarray) -> np.ndarray:
    out = np.empty((len(packed), 2 * packed.shape[1]), np.uint8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out


def near_axes(x: np.ndarray, rot: np.ndarray, ratio: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and signed axes of every rotated coordinate within ``ratio`` of the row's strongest one.

    The strongest axis is a row's own cell; the others are the adjacent cells that it nearly fell into. ``most`` bounds the
    copies of one row, not of a cell.
    """
    y = x @ rot
    size = np.abs(y)
    top = np.argpartition(-size, most - 1, axis=1)[:, :most]
    value = np.take_along_axis(size, top, 1)
    rows, cols = np.nonzero(value >= ratio * value.max(1, keepdims=True))
    axis = top[rows, cols]
    return rows, (2 * axis + (y[rows, axis] < 0)).astype(np.int32)


#: Float32 scores nearer than this to the threshold are computed again in float64.
CLOSE = 1e-5
#: Rows by rows of a block of scores: 1 MB, so that they are still in the cache when they are looked through.
TILE = 512


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of ``a`` and ``b`` pair by pair; every row of ``root`` points at the smallest position of its tree."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root[:] = root[root]


def link_rows(x: np.ndarray, label: np.ndarray, least: float, block: int = TILE, split: int = 0) -> np.ndarray:
    """For each unit row the smallest position of its group: rows of one label, and rows joined through pairs of cosine >= ``least``.

    Every pair of rows that is not joined yet is compared, block by block; with ``split`` only those of a row before it and one from it
    on. Scores are float32 products, those within ``CLOSE`` of the threshold float64 ones. Returns positions.
    """
    n, y = len(x), x.astype(np.float32)
    _, first, code = np.unique(label, return_index=True, return_inverse=True)
    root = first[code]
    for start in range(0, split or n, block):
        stop = min(split or n, start + block)
        for at in range(split or start, n, block):
            own, other = root[start:stop], root[at : at + block]
            if (own == own[0]).all() and (other == own[0]).all():
                continue  # all of one group already
            score = y[start:stop] @ y[at : at + block].T
            a, b = np.divmod(np.flatnonzero(score >= least - CLOSE), score.shape[1])
            near = score[a, b] < least + CLOSE
            a, b = a + start, b + at
            keep = root[a] != root[b]
            if keep.any():
                a, b, near = a[keep], b[keep], near[keep]
                near = np.flatnonzero(near)
                low = near[(x[a[near]].astype(np.float64) * x[b[near]]).sum(1) < least]
                _unite(root, np.delete(a, low), np.delete(b, low))
    return root


def link_between(x: np.ndarray | tuple[np.ndarray, np.ndarray], one: np.ndarray, y: np.ndarray | tuple[np.ndarray, np.ndarray], two: np.ndarray, least: float, block: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of labels that are joined through a row of ``x`` and one of ``y`` at a cosine >= ``least``; ``one`` and ``two`` are the rows'
    labels. Every pair of rows whose labels are not joined yet is compared, as in :func:`link_rows`. ``x`` and ``y`` may be pairs: the
    vectors, and their :func:`units`."""
    x, u = x if isinstance(x, tuple) else (x, units(x))
    y, v = y if isinstance(y, tuple) else (y, units(y))
    names, code = np.unique(np.concatenate([one, two]), return_inverse=True)
    a_code, b_code, root = code[: len(one)], code[len(one) :], np.arange(len(names))
    room = np.empty(min(block, len(u)) * min(block, len(v)), np.float32)  # not allocated for each block: its pages would be cleared every time
    for start in range(0, len(u), block):
        for at in range(0, len(v), block):
            own, other = root[a_code[start : start + block]], root[b_code[at : at + block]]
            if (own == own[0]).all() and (other == own[0]).all():
                continue
            score = np.matmul(u[start : start + block], v[at : at + block].T, out=room[: len(own) * len(other)].reshape(len(own), len(other)))
            if score.max() < least - CLOSE:
                continue
            a, b = np.divmod(np.flatnonzero(score >= least - CLOSE), score.shape[1])
            keep = own[a] != other[b]
            a, b, near = a[keep], b[keep], score[a[keep], b[keep]] < least + CLOSE
            near = np.flatnonzero(near)
            if len(near):
                low = near[(unit(x[a[near] + start]) * unit(y[b[near] + at])).sum(1) < least]
                a, b = np.delete(a, low), np.delete(b, low)
            _unite(root, own[a], other[b])
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def units(x: np.ndarray, chunk: int = 8192) -> np.ndarray:
    """:func:`unit` in float32, some rows at a time."""
    out = np.empty(x.shape, np.float32)
    for at in range(0, len(x), chunk):
        out[at : at + chunk] = unit(x[at : at + chunk])
    return out

"""Vector expressions over ARRAY columns, evaluated in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector becomes null."""
    n = l2_norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n))


def rms_norm(v: Column, eps: float = 1e-6) -> Column:
    """``x / sqrt(mean(x^2) + eps)``; an empty vector becomes null."""
    scale = F.sqrt(F.try_divide(dot(v, v), F.size(v).cast("double")) + eps)
    return F.transform(doubles(v), lambda x: x / scale)


def heads(v: Column, n: int) -> Column:
    """Equal slices, one per head."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda h: F.slice(v, (h * (F.size(v) / n) + 1).cast("int"), (F.size(v) / n).cast("int")))


def kv_head(head: Column, query_heads: int, kv_heads: int) -> Column:
    """The shared key/value head that a query head uses."""
    return F.floor(head / (query_heads // kv_heads)).cast("int")


def linear(v: Column, rows: Column, bias: Column | None = None) -> Column:
    """``W x (+ b)``; ``rows`` holds the rows of W."""
    out = F.transform(rows, lambda r: dot(v, r))
    return out if bias is None else F.zip_with(out, bias, lambda x, b: x + b)


def pool_tokens(tokens: DataFrame, key: str, how: str = "last") -> DataFrame:
    """One vector per text from token rows ``(key, pos, vec, mask)``; masked tokens never count. ``how``: first, last or mean."""
    live = tokens.filter("mask")
    if how in ("first", "last"):
        pick = F.min_by if how == "first" else F.max_by
        return live.groupBy(key).agg(pick("vec", "pos").alias("vec"))
    parts = live.select(key, F.posexplode("vec").alias("dim", "x")).groupBy(key, "dim").agg(F.avg("x").alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vec"))

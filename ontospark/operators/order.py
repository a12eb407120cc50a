"""Positions over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges that a table is cut into, and rows looked at to cut it evenly; both bound what reaches the driver, not the result.
RANGES, LOOKED_AT = 64, 4096


def ranged(df: DataFrame, by: str, name: str = "_range") -> DataFrame:
    """``df`` with the number of the range of ``by`` that a row lies in; nulls lie in range 0."""
    seen = sorted(r[0] for r in df.select(by).filter(F.col(by).isNotNull()).orderBy(F.xxhash64(by)).limit(LOOKED_AT).collect())
    cuts = sorted(set(seen[len(seen) // RANGES :: max(1, len(seen) // RANGES)][: RANGES - 1]))
    if not cuts:
        return df.withColumn(name, F.lit(0))
    kind = df.schema[by].dataType
    at = F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]), lambda c: c <= F.col(by)))
    return df.withColumn(name, F.coalesce(at, F.lit(0)))


def numbered(df: DataFrame, by: str, name: str = "pos") -> DataFrame:
    """``df`` with each row's position (from 0) in the order of ``by``; nulls first, ties in any order.

    Each range is numbered by itself and moved on by the number of rows before it. An empty table gives no rows.
    """
    rows = ranged(df, by)
    count = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row per range
    before = count.select("_range", F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(by).asc_nulls_first()))
    return rows.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + inside - 1).cast("long")).drop("_range", "_before")

"""Windowed aggregates that run alike on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark(ts, late)
    g = events.groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark(ts, late)
    g = events.groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("start"), by, "n")


def deduplicated(events: DataFrame, ts: str, key: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])

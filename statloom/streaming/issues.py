"""Incremental issues: sums by period kept as a stream, for ratings that use strictly earlier periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def period_sums(events: DataFrame, ts: str, value: str, period: str = "7 days", late: str = "1 day") -> DataFrame:
    """Sums of each period, for a streaming or a whole table; on a stream a period
    is given when the watermark passes its end."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    sums = events.groupBy(F.window(ts, period)).agg(F.sum(F.col(value).cast("decimal(18,4)")).alias("total"), F.count("*").alias("n"))
    return sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "total", "n")

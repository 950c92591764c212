"""Profiles of a stream of events: windowed counts, sums and squares, from which means and variances follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str = "ts", value: str = "value", key: str = "event_type", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, key, n, total, squares) for each window; on a stream, events later than `late` are dropped by the watermark."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    by = events.groupBy(F.window(time, window).alias("w"), F.col(key)).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.sum(F.col(value) ** 2).alias("squares"))
    return by.select(F.col("w.start").alias("start"), key, "n", "total", "squares")


def merged(parts: DataFrame, key: str = "event_type") -> DataFrame:
    """Mean and sample variance of each key over all windows."""
    n, t, q = F.sum("n"), F.sum("total"), F.sum("squares")
    return parts.groupBy(key).agg(n.alias("n"), (t / n).alias("mean"), ((q - t * t / n) / F.nullif(n - 1, F.lit(0))).alias("variance"))

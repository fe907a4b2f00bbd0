"""Streams of results: window statistics with late data bounded by a watermark. An extension; batch reports don't need it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str = "ts", key: str = "user_id", value: str = "value", width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Count, mean and best value by key and tumbling window. Rows later than the watermark are dropped by Spark."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = e.groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("best"))
    return out.select(F.col("window.start").alias("start"), key, "n", "mean", "best")


def sittings(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """A key's runs of events with no gap longer than `gap`."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = e.groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")

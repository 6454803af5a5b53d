"""OHLC bars of event values; the same plan for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_bars(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``event_type, start, open, high, low, close, n`` per window; state older than the watermark is dropped."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    order = F.struct("ts", "event_id")
    bars = events.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n"))
    return bars.select("event_type", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")

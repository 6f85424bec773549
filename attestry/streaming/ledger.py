"""Roll-ups of ledgers that are still being written; an extension with the batch result as its test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_calls(calls: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window start, event_type, calls and value of a stream or table of calls (ts, event_type, value)."""
    x = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if calls.isStreaming else calls
    return x.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("value")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "calls", "value")

"""Windows over events; the same plan serves batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame) -> DataFrame:
    """Event time as TIMESTAMP, which alone can carry a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of value per event type and window; a stream's state goes once the watermark has passed a window."""
    at = F.window("ts", width)
    grouped = _timed(events).withWatermark("ts", late).groupBy(at.alias("window"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events per user and session."""
    grouped = _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("window.start").cast("timestamp_ntz").alias("session_start"), "n")

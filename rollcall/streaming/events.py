"""Event streams: the same windowed counts on a batch table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, minutes: int, late_minutes: int | None = None) -> DataFrame:
    """Events and their value by type and tumbling window; on a stream with a watermark."""
    if events.isStreaming:
        events = events.withWatermark("ts", f"{late_minutes or minutes} minutes")
    out = events.groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap_minutes: int, late_minutes: int | None = None) -> DataFrame:
    """Sessions of a user: events no further apart than the gap."""
    if events.isStreaming:
        events = events.withWatermark("ts", f"{late_minutes or gap_minutes} minutes")
    out = events.groupBy(F.session_window("ts", f"{gap_minutes} minutes"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")

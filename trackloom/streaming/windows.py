"""Streaming forms of the window statistics: event-time windows behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_windows(events: DataFrame, length: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Counts, distinct tracks (approximate) and mean value per scope and tumbling window.

    ``events`` has event_time (timestamp), scope, track_id and value; rows later than the
    watermark are left out, as a batch over the same rows in order would have had them earlier.
    """
    windowed = events.withWatermark("event_time", late).groupBy("scope", F.window("event_time", length))
    out = windowed.agg(F.count("*").alias("n"), F.approx_count_distinct("track_id").alias("tracks"), F.avg("value").alias("mean_value"))
    return out.select("scope", F.col("window.start").alias("start"), "n", "tracks", "mean_value")


def stream_sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 minute") -> DataFrame:
    """Gap-free runs of each track as session windows."""
    runs = events.withWatermark("event_time", late).groupBy("track_id", F.session_window("event_time", gap)).agg(F.count("*").alias("n"))
    return runs.select("track_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def stream_dedup(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("event_time", late).dropDuplicatesWithinWatermark(keys)

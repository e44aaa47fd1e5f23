"""Streams of events: windows, exact repeats, and timelines kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """With a watermark on a timestamp of the session's time zone; files may hold one without a zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def distinct_events(stream: DataFrame, keys: list[str], late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Each key once within the watermark; state is dropped behind it."""
    return _timed(stream, time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour", by: str = "event_type", time: str = "ts") -> DataFrame:
    """Tumbling, or sliding, windows."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return _timed(stream, time, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour", by: str = "user_id", time: str = "ts") -> DataFrame:
    return _timed(stream, time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def timeline_spans(stream: DataFrame, keys: tuple[str, ...] = ("user_id", "event_type"), time: str = "ts") -> DataFrame:
    """Per timeline its first and last time and its events so far; additive, so state is one row per timeline."""
    return stream.groupBy(*keys).agg(F.min(time).alias("time_span_start"), F.max(time).alias("time_span_end"), F.count(F.lit(1)).alias("n"))

"""Audit events as a stream: windowed counts with late data, retention, duplicate inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time zone


def counts(events: DataFrame, length: str = "6 hours", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by window and action; events later than ``late`` are dropped and their windows' state freed."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return _timed(events).withWatermark("ts", late).groupBy(w.alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "action", "n")


def session_counts(events: DataFrame, gap: str = "4 hours", late: str = "1 hour") -> DataFrame:
    return _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "tenant").agg(F.count("*").alias("n")).select("tenant", F.col("w.start").alias("window_start"), "n")


def without_repeats(inputs: DataFrame, late: str = "10 minutes", key: str = "signature") -> DataFrame:
    """The first input of each signature (name, type and size) within the time that is waited for late ones."""
    return _timed(inputs).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])

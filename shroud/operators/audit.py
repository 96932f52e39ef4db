"""Metadata-only audit tables: summaries, retention, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEWEST = 250
RETENTION_DAYS = 30


def finding_type(x: Column) -> Column:
    """Lower case, runs of other characters to one underscore, never empty."""
    low = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(low, F.lit("")), F.lit("secret"))


def summary(events: DataFrame, *keys: str) -> DataFrame:
    """Number of findings and their distinct types for each key."""
    return events.groupBy(*keys).agg(F.count("*").alias("n_findings"), F.array_sort(F.collect_set(finding_type(F.col("finding_type")))).alias("finding_types"))


def bounded(events: DataFrame, now: Column, days: int = RETENTION_DAYS, newest: int = NEWEST, tenant: str = "tenant") -> DataFrame:
    """Events inside the retention time, and of those each tenant's newest. Rank limits push down as a top-k for each group."""
    days = max(1, min(365, days))
    fresh = events.where(F.col("ts") >= now - F.make_dt_interval(days=F.lit(days)))
    rank = F.row_number().over(Window.partitionBy(tenant).orderBy(F.desc("ts"), F.desc("event_id")))
    return fresh.withColumn("rank", rank).where(F.col("rank") <= newest)


def windowed(events: DataFrame, length: str, slide: str | None = None, *keys: str) -> DataFrame:
    """Counts by tumbling or sliding window."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def sessions(events: DataFrame, gap: str, *keys: str) -> DataFrame:
    """Counts by runs of events of a key that are never further apart than the gap."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def latency(events: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean and nearest-rank percentiles."""
    q = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(a) for p, a in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), *q)

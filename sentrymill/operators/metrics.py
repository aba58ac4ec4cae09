"""Counts and rates over a trailing window, and what the dashboard derives from them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import iso_millis, rate4
from ..sources.tables import with_ms
from .listing import filter_events

# Window limits and the columns metrics may group by.
DEFAULT_WINDOW = 60
MIN_WINDOW = 10
MAX_WINDOW = 3600
GROUP_COLUMNS = ("event_type", "source")


def resolve_window(window_seconds: float | None, clamp: bool = False, unlimited: bool = False) -> int:
    """The window in seconds; outside its limits an error, or clamped on request.
    ``unlimited`` allows longer windows, for tables rather than live panels."""
    if window_seconds is None:
        return DEFAULT_WINDOW
    if window_seconds != window_seconds or window_seconds in (float("inf"), float("-inf")) or window_seconds != int(window_seconds):
        raise ValueError("window_seconds must be an integer")
    w = int(window_seconds)
    if unlimited and w >= 1:
        return w
    if clamp:
        return min(max(w, MIN_WINDOW), MAX_WINDOW)
    if not MIN_WINDOW <= w <= MAX_WINDOW:
        raise ValueError(f"window_seconds must be between {MIN_WINDOW} and {MAX_WINDOW}")
    return w


def resolve_group(group_by: str | None) -> str:
    group_by = "event_type" if group_by is None else group_by
    if group_by not in GROUP_COLUMNS:
        raise ValueError("group_by must be one of: " + ", ".join(GROUP_COLUMNS))
    return group_by


def window_metrics(
    events: DataFrame,
    as_of: datetime,
    window_seconds: int | None = None,
    group_by: str | None = None,
    event_type: str | None = None,
    source: str | None = None,
    clamp: bool = False,
    unlimited: bool = False,
) -> DataFrame:
    """Count and rate per key over ``[as_of - window, as_of]``, both ends inclusive."""
    w, key = resolve_window(window_seconds, clamp, unlimited), resolve_group(group_by)
    start = as_of - timedelta(seconds=w)
    counts = (
        filter_events(events, event_type, source, start, as_of)
        .groupBy(F.col(key).alias("key"))
        .agg(F.count("*").alias("count"))
    )
    return metric_rows(counts, start, as_of, w, key)


def metric_rows(counts: DataFrame, start: datetime, end: datetime, window_seconds: int, group_by: str) -> DataFrame:
    """Counts by key with their rate and the window they are of."""
    return counts.select(
        F.lit(window_seconds).alias("window_seconds"),
        F.lit(group_by).alias("group_by"),
        iso_millis(F.lit(start)).alias("from"),
        iso_millis(F.lit(end)).alias("to"),
        "key",
        "count",
        rate4(F.col("count"), window_seconds).alias("rate_per_sec"),
    )


def health_class(pct: Column) -> Column:
    return F.when(pct < 1, "Healthy").when(pct < 5, "Warning").otherwise("Critical")


def error_rate(metrics: DataFrame) -> DataFrame:
    """Share of counts whose key speaks of an error or failure, in percent, and its
    class; no row when there are no metrics."""
    key = F.lower("key")
    failing = key.contains("error") | key.contains("fail")
    errors = F.coalesce(F.sum(F.when(failing, F.col("count"))), F.lit(0)).alias("error_count")
    totals = metrics.agg(errors, F.sum("count").alias("total_count")).filter("total_count is not null")
    pct = F.when(
        F.col("total_count") > 0, F.col("error_count") / F.col("total_count") * F.lit(100.0)
    ).otherwise(F.lit(0.0))
    return totals.withColumn("error_pct", pct).withColumn("status", health_class(F.col("error_pct")))


def top_events(metrics: DataFrame, sort_by: str = "count", ascending: bool = False) -> DataFrame:
    """Metrics rows by key, count or rate; ties by key."""
    if sort_by not in ("key", "count", "rate_per_sec"):
        raise ValueError("sort_by must be one of: key, count, rate_per_sec")
    order = F.asc(sort_by) if ascending else F.desc(sort_by)
    return metrics.select("key", "count", "rate_per_sec").orderBy(order, "key")


def throughput(metrics: DataFrame) -> DataFrame:
    return metrics.select("key", "rate_per_sec", "count")


def bucket_counts(events: DataFrame, bucket_seconds: int) -> DataFrame:
    """Events per fixed time bucket, empty buckets absent."""
    size = int(bucket_seconds * 1000)
    start = (F.floor(F.col("ts_ms") / F.lit(size)) * F.lit(size)).alias("bucket_start_ms")
    return with_ms(events).groupBy(start).agg(F.count("*").alias("count"))

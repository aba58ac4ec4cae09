"""Counts per minute kept by a stream, and window metrics read from them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from ..operators.listing import filter_events
from ..operators.metrics import metric_rows, resolve_group, resolve_window
from .state import DELAY

MINUTE = timedelta(minutes=1)


def minute_rollup(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """A stream's events per minute, type and source, each once: when the watermark, ``delay`` behind the
    newest event, has passed the minute. Later events of that minute aren't counted."""
    return (
        events.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", "1 minute"), "event_type", "source")
        .agg(F.count("*").alias("count"))
        .select(F.col("window.start").alias("minute"), "event_type", "source", "count")
    )


def sealed_until(rollup: DataFrame) -> datetime | None:
    """The end of the newest minute of the rollup: it is only there after all before it."""
    newest = rollup.agg(F.max("minute")).first()[0]
    return None if newest is None else newest.astimezone() + MINUTE


def counted(
    rollup: DataFrame, events: DataFrame, start: datetime, end: datetime, keys: list[str],
    event_type: str | None = None, source: str | None = None,
) -> DataFrame:
    """Counts by ``keys`` and ``minute`` over ``[start, end]``: whole minutes come from the rollup, what is
    before the first and after the last of them from the events."""
    first = start.replace(second=0, microsecond=0)
    first = first if first == start else first + MINUTE
    last = min(end.replace(second=0, microsecond=0), sealed_until(rollup) or first)
    last = max(last, first)
    edges = filter_events(events, event_type, source, start, end).filter(
        (F.col("timestamp") < F.lit(first)) | (F.col("timestamp") >= F.lit(last)))
    whole = rollup.filter((F.col("minute") >= F.lit(first)) & (F.col("minute") < F.lit(last)))
    for column, value in (("event_type", event_type), ("source", source)):
        if value is not None:
            whole = whole.filter(F.col(column) == value)
    return whole.groupBy("minute", *keys).agg(F.sum("count").alias("count")).unionByName(
        edges.groupBy(F.date_trunc("minute", "timestamp").alias("minute"), *keys).agg(F.count("*").alias("count")))


def window_metrics(
    rollup: DataFrame, events: DataFrame, as_of: datetime, window_seconds: int | None = None, group_by: str | None = None,
    event_type: str | None = None, source: str | None = None, clamp: bool = False, unlimited: bool = False,
) -> DataFrame:
    """As ``metrics.window_metrics``, but only the edges of the window are counted from events."""
    w, key = resolve_window(window_seconds, clamp, unlimited), resolve_group(group_by)
    start = as_of - timedelta(seconds=w)
    counts = counted(rollup, events, start, as_of, [key], event_type, source)
    return metric_rows(counts.groupBy(F.col(key).alias("key")).agg(F.sum("count").alias("count")), start, as_of, w, key)


def bucket_counts(rollup: DataFrame, events: DataFrame, start: datetime, end: datetime, bucket_minutes: int) -> DataFrame:
    """Events of ``[start, end]`` per bucket of whole minutes, empty buckets absent."""
    size = bucket_minutes * 60_000
    at = (F.floor(F.unix_millis("minute") / F.lit(size)) * F.lit(size)).alias("bucket_start_ms")
    return counted(rollup, events, start, end, []).groupBy(at).agg(F.sum("count").alias("count"))

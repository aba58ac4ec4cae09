"""Filtered, ordered, paged reads of the event and anomaly tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

# Paging and dashboard defaults.
DEFAULT_LIMIT = 50
MAX_LIMIT = 500
FEED_LIMIT = 100
RANGE_SECONDS = {"15m": 900, "1h": 3600, "6h": 21600, "24h": 86400, "custom": 3600}
MAX_METRICS_SECONDS = 3600


def page_args(limit: int | None = None, offset: int | None = None) -> tuple[int, int]:
    """Limit within [1, 500], 50 by default; offset at least 0."""
    for name, v in (("limit", limit), ("offset", offset)):
        if v is not None and v != int(v):
            raise ValueError(f"{name} must be an integer")
    size = DEFAULT_LIMIT if limit is None else int(limit)
    return min(max(size, 1), MAX_LIMIT), max(int(offset or 0), 0)


def check_range(start: datetime | None, end: datetime | None) -> None:
    if start is not None and end is not None and start > end:
        raise ValueError("from must not be after to")


def filter_events(
    events: DataFrame,
    event_type: str | None = None,
    source: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Only the filters that are set apply; both ends of the range are inclusive."""
    check_range(start, end)
    if event_type is not None:
        events = events.filter(F.col("event_type") == event_type)
    if source is not None:
        events = events.filter(F.col("source") == source)
    if start is not None:
        events = events.filter(F.col("timestamp") >= F.lit(start))
    if end is not None:
        events = events.filter(F.col("timestamp") <= F.lit(end))
    return events


def list_events(
    events: DataFrame,
    limit: int | None = None,
    offset: int | None = None,
    after: tuple[datetime, str] | None = None,
    **filters,
) -> DataFrame:
    """A page of events, newest first by ingest time, ties by id.

    ``after`` is the (created_at, event_id) of the last row seen: paging by key
    costs the same at any depth, where an offset reads all rows it skips.
    """
    limit, offset = page_args(limit, offset)
    rows = filter_events(events, **filters)
    if after is not None:
        at, last_id = F.lit(after[0]), F.lit(after[1])
        older, tied = F.col("created_at") < at, F.col("created_at") == at
        rows = rows.filter(older | (tied & (F.col("event_id") > last_id)))
    return rows.orderBy(F.desc("created_at"), "event_id").offset(offset).limit(limit)


def get_event(events: DataFrame, event_id: str) -> DataFrame:
    """The event with this id, or no row."""
    return events.filter(F.col("event_id") == event_id).limit(1)


def list_anomalies(
    anomalies: DataFrame,
    limit: int | None = None,
    offset: int | None = None,
    rule_id: str | None = None,
    severity: str | None = None,
) -> DataFrame:
    """A page of anomalies, newest first by detection time, ties by id."""
    limit, offset = page_args(limit, offset)
    if rule_id is not None:
        anomalies = anomalies.filter(F.col("rule_id") == rule_id)
    if severity is not None:
        anomalies = anomalies.filter(F.col("severity") == severity)
    return anomalies.orderBy(F.desc("detected_at"), "anomaly_id").offset(offset).limit(limit)


def page_info(page: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """The envelope of a page: its limit and offset, and the rows in this page."""
    limit, offset = page_args(limit, offset)
    return page.agg(F.count("*").alias("count")).select(
        F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), "count"
    )


def dashboard_range(name: str, as_of: datetime) -> tuple[datetime, int]:
    """Start of a named range, and the window its metrics use."""
    seconds = RANGE_SECONDS[name]
    return as_of - timedelta(seconds=seconds), min(seconds, MAX_METRICS_SECONDS)


def live_feed(events: DataFrame, range_name: str, as_of: datetime, **filters) -> DataFrame:
    """The newest events of a dashboard range."""
    start, _ = dashboard_range(range_name, as_of)
    return list_events(events, FEED_LIMIT, start=start, **filters)


def anomaly_timeline(anomalies: DataFrame, severity: str | None = None) -> DataFrame:
    """The newest anomalies for the dashboard."""
    return list_anomalies(anomalies, FEED_LIMIT, severity=severity)


def anomaly_drilldown(anomalies: DataFrame, events: DataFrame) -> DataFrame:
    """Each anomaly with its event; the event may be gone by then."""
    detail = events.select(
        "event_id", "event_type", "source", F.col("timestamp").alias("event_time"), "payload"
    )
    return anomalies.join(detail, "event_id", "left")

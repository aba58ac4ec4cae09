"""Retention: rows older than a number of days go."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import checkpointed, delete_folder

# Days kept by default.
EVENT_DAYS = 30
ANOMALY_DAYS = 90


def keep_recent(df: DataFrame, time_column: str, days: int, as_of: datetime) -> DataFrame:
    """Rows that stay: not older than ``days`` before ``as_of``; 0 days keeps all."""
    if days <= 0:
        return df
    return df.filter(F.col(time_column) >= F.lit(as_of - timedelta(days=days)))


def retain_events(events: DataFrame, as_of: datetime, days: int = EVENT_DAYS) -> DataFrame:
    return keep_recent(events, "timestamp", days, as_of)


def retain_anomalies(anomalies: DataFrame, as_of: datetime, days: int = ANOMALY_DAYS) -> DataFrame:
    return keep_recent(anomalies, "detected_at", days, as_of)


def drop_expired_days(spark: SparkSession, path: str, as_of: datetime, days: int, time_column: str = "timestamp") -> list[str]:
    """Apply retention to a table stored by ``event_date``.

    Whole days before the cut are deleted as folders, without reading a row. The day of the cut is
    overwritten by its rows that stay, which are written beside the table first; other days aren't touched.
    No rows of that day may be appended meanwhile. Again does no harm. Returns the days removed.
    """
    if days <= 0:
        return []
    cut = as_of - timedelta(days=days)
    day = cut.date()
    stored = spark.read.parquet(path).filter(F.col("event_date").isNotNull())
    found = [r.event_date.isoformat() for r in stored.filter(F.col("event_date") <= F.lit(day)).select("event_date").distinct().orderBy("event_date").collect()]
    kept = 0
    if day.isoformat() in found:
        of_day = stored.filter(F.col("event_date") == F.lit(day))
        stays = F.col(time_column) >= F.lit(cut)
        counts = of_day.agg(F.count_if(stays).alias("kept"), F.count_if(~stays).alias("expired")).first()
        kept = counts.kept
        if counts.expired and kept:
            checkpointed(of_day.filter(stays)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "event_date").parquet(path)
    removed = [d for d in found if d < day.isoformat() or not kept]
    for d in removed:
        delete_folder(spark, f"{path}/event_date={d}")
    return removed

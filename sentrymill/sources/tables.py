"""Event table readers and writers."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import use_utc

SOURCE_PREFIX = "user-"


def bind_events(
    spark: SparkSession,
    sf_dir: str,
    start: datetime | None = None,
    end: datetime | None = None,
    event_id: str | None = None,
    source: str | None = None,
) -> DataFrame:
    """The driver's ``events`` table in canonical form.

    ``start`` and ``end`` (both inclusive, UTC), ``event_id`` and ``source`` go onto the
    stored columns before they are cast, so that they reach the Parquet scan as pushed
    filters. An id or source that no stored number gives selects nothing.
    """
    use_utc(spark)
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    if start is not None:
        raw = raw.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        raw = raw.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    if event_id is not None:
        raw = raw.filter(_stored("event_id", event_id))
    if source is not None:
        raw = raw.filter(_stored("user_id", source.removeprefix(SOURCE_PREFIX)) if source.startswith(SOURCE_PREFIX) else F.lit(False))
    ts = F.col("ts").cast("timestamp")
    return raw.select(
        F.col("event_id").cast("string").alias("event_id"),
        "event_type",
        F.concat(F.lit(SOURCE_PREFIX), F.col("user_id").cast("string")).alias("source"),
        ts.alias("timestamp"),
        F.col("props").alias("payload"),
        F.lit("{}").alias("metadata"),
        ts.alias("created_at"),
        F.col("event_id").alias("seq"),
    )


def _stored(column: str, text: str) -> Column:
    """Whether a stored number has this text."""
    number = re.fullmatch("0|-?[1-9][0-9]{0,17}", text)
    return F.col(column) == F.lit(int(text)).cast("bigint") if number else F.lit(False)


def with_ms(events: DataFrame) -> DataFrame:
    """Add ``ts_ms``, epoch milliseconds, the unit of all window maths."""
    return events.withColumn("ts_ms", F.unix_millis("timestamp"))


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Store events by day, so that time filters and retention prune folders.

    The rebalance gathers each day into few files and splits a day that is much
    larger than the others, by its size at run time.
    """
    (
        events.withColumn("event_date", F.to_date("timestamp"))
        .hint("rebalance", F.col("event_date"))
        .write.mode(mode)
        .partitionBy("event_date")
        .parquet(path)
    )


def read_events(
    spark: SparkSession,
    path: str,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Read a stored event table; a time range also prunes its day folders."""
    use_utc(spark)
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter((F.col("event_date") >= F.lit(start.date())) & (F.col("timestamp") >= F.lit(start)))
    if end is not None:
        df = df.filter((F.col("event_date") <= F.lit(end.date())) & (F.col("timestamp") <= F.lit(end)))
    return df

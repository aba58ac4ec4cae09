"""Tables the streaming pipeline appends to, each append safe to repeat."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from ..schemas import ANOMALIES, EVENTS
from ..session import checkpointed

# Keys of a micro-batch that may be broadcast; ids are a few dozen bytes each.
BATCH_KEYS = 500_000


def utc(local: datetime) -> datetime:
    """Collected timestamps are naive in the driver's zone."""
    return local.astimezone()


def _stored(schema: T.StructType) -> T.StructType:
    extra = [T.StructField("batch_id", T.LongType()), T.StructField("event_date", T.DateType())]
    return T.StructType([*schema.fields, *extra])


OUTBOX = T.StructType([
    T.StructField(c, T.StringType())
    for c in ("anomaly_id", "rule_id", "severity", "channel", "status", "target", "body")
])
ARRIVALS = T.StructType([
    EVENTS[c] for c in ("event_id", "event_type", "source", "timestamp", "seq")
])
PARKED = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("metadata", T.StringType()),
])


# A stored batch: the time range of its events, up to which event time detection went before it
# (``since``) and with it (``upto``), and the detectors that are through with it. Later rows of a batch add to that.
BATCHES = T.StructType([
    T.StructField("batch", T.LongType()),
    *[T.StructField(c, T.TimestampType()) for c in ("lo", "hi", "since", "upto")],
    T.StructField("done", T.ArrayType(T.StringType())),
])


@dataclass(frozen=True)
class Table:
    """A Parquet table by day. ``key`` identifies a row; ``time`` gives its day.

    ``fixed_time`` says that rows of one key always have the same time, so that a
    look for stored keys can keep to the days of the new rows.
    """

    path: str
    schema: T.StructType
    key: tuple[str, ...]
    time: str | None
    fixed_time: bool = False

    def create(self, spark: SparkSession) -> None:
        spark.createDataFrame([], self.schema).write.mode("append").parquet(self.path)

    def read(self, spark: SparkSession, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """Rows of the table; a time range prunes day folders before rows."""
        df = spark.read.schema(_stored(self.schema)).parquet(self.path)
        if since is not None:
            df = df.filter((F.col("event_date") >= F.to_date(F.lit(since))) & (F.col(self.time) >= F.lit(since)))
        if until is not None:
            df = df.filter((F.col("event_date") <= F.to_date(F.lit(until))) & (F.col(self.time) <= F.lit(until)))
        return df

    def note(self, rows: DataFrame, batch_id: int) -> None:
        """Append a few bookkeeping rows as they are; readers, at a start, take repeated ones as one."""
        self._write(rows.coalesce(1), batch_id, F.current_date())

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Append rows that are known not to be stored: no row is read."""
        self._write(rows, batch_id, self._day())

    def append_new(self, rows: DataFrame, batch_id: int, unseen: bool = False) -> None:
        """Append the rows whose key is not stored yet.

        A replayed batch finds what an earlier attempt managed to write and adds
        only the rest, so repeating it any number of times stores each row once. With
        ``unseen`` the caller knows that no other batch has these keys: then only what this
        batch wrote is looked at, in the days of its rows.
        """
        rows = checkpointed(rows)
        key = list(self.key)
        time = F.col(self.time) if self.time else F.lit(None).cast("timestamp")
        seen = rows.agg(F.count("*").alias("n"), F.min(time).alias("lo"), F.max(time).alias("hi")).first()
        if seen.n == 0:
            return
        # The keys of the batch go to the table, not the table to the batch: within
        # the bound the stored keys are scanned in place, without a shuffle.
        present = self._stored_keys(rows, key, seen, batch_id if unseen else None)
        self._write(rows.join(present, key, "left_anti"), batch_id, self._day())

    def _day(self) -> Column:
        return F.to_date(self.time) if self.time else F.current_date()

    def _write(self, rows: DataFrame, batch_id: int, day: Column) -> None:
        (
            rows.select(*self.schema.fieldNames())
            .withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            .withColumn("event_date", day)
            .hint("rebalance", F.col("event_date"))
            .write.mode("append")
            .partitionBy("event_date")
            .parquet(self.path)
        )

    def _stored_keys(self, rows: DataFrame, key: list[str], seen: Row, only_batch: int | None) -> DataFrame:
        by_day = self.time is not None and (self.fixed_time or only_batch is not None)
        stored = self.read(rows.sparkSession, *((utc(seen.lo), utc(seen.hi)) if by_day else ()))
        if only_batch is not None:
            stored = stored.filter(F.col("batch_id") == only_batch)
        wanted = rows.select(*key)
        if seen.n <= BATCH_KEYS:
            wanted = F.broadcast(wanted)
        return stored.select(*key).join(wanted, key, "left_semi").distinct()


@dataclass(frozen=True)
class Layout:
    """All tables under one root folder."""

    root: str

    @property
    def events(self) -> Table:
        return Table(f"{self.root}/events", EVENTS, ("event_id",), "timestamp")

    @property
    def anomalies(self) -> Table:
        return Table(f"{self.root}/anomalies", ANOMALIES, ("anomaly_id",), "detected_at", fixed_time=True)

    @property
    def outbox(self) -> Table:
        return Table(f"{self.root}/outbox", OUTBOX, ("anomaly_id", "channel"), None)

    @property
    def parked(self) -> Table:
        return Table(f"{self.root}/parked", PARKED, ("seq",), None)

    @property
    def late(self) -> Table:
        return Table(f"{self.root}/late", EVENTS, ("event_id",), "timestamp")

    @property
    def arrivals(self) -> Table:
        """Every entry that arrived, copies of an event included."""
        return Table(f"{self.root}/arrivals", ARRIVALS, ("event_id", "seq"), "timestamp", fixed_time=True)

    @property
    def batches(self) -> Table:
        return Table(f"{self.root}/batches", BATCHES, ("batch",), None)

    @property
    def rules(self) -> str:
        return f"{self.root}/rules"

    def create(self, spark: SparkSession) -> None:
        for table in (
            self.events, self.anomalies, self.outbox, self.parked, self.late, self.arrivals, self.batches,
        ):
            table.create(spark)

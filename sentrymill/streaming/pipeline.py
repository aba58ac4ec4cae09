"""From the event log to stored events, anomalies and notifications.

Each micro-batch is stored first; detectors then run over the batch and as much
stored history as their windows reach back, with the operators used in batch. All
state of the detectors lives in the tables: events give the windows, anomalies give the
earlier fires. So a busy rule is spread over tasks like in batch, nothing is lost with an
executor, and a replayed batch gives the same rows.

The log is a folder of JSON files, taken by their times. Copies of an event are dropped in the
stream itself, by ids held in its state. Detection goes by event time: it can stay a while behind the newest
event, and what arrives out of order within that while is taken in order. A detector
that fails on a batch takes it up again, and the batches after it in turn, when the next batch comes.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import outbox, threshold, zscore
from ..operators.ingest import dedup_events
from ..operators.joins import Control
from ..operators.rules import read_rules
from ..schemas import STREAM_ENTRY
from ..session import checkpointed, delete_folder, folder_exists, scratch, shared_folder, tables_in, use_utc
from ..sources.codec import decode_events
from .state import rocksdb
from .tables import BATCHES, Layout, Table, utc

log = logging.getLogger(__name__)

# Fixed value: entries of the log taken per read; here files, whose size the writer sets.
FILES_PER_BATCH = 100
# Events so much older than the newest of earlier batches are also listed as late.
LATE_SECONDS = 3600
# How long after its arrival an event's id is held to drop copies: as long as events are kept.
ID_DELAY = "30 days"
# Between an event's id and its arrival number, where copies are evaluated too.
COPY_MARK = "\x1f"


def read_log(
    spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH, start_at: datetime | None = None,
    archive: str | None = None,
) -> DataFrame:
    """The append-only log as a stream of JSON-lines files, one entry per line with
    its number ``seq`` and a ``fields`` map. ``start_at`` skips files written earlier. Files that
    are through move to the folder ``archive``, if given.
    """
    use_utc(spark)
    stream = spark.readStream.schema(STREAM_ENTRY).option("maxFilesPerTrigger", files_per_batch)
    if archive is not None:
        stream = stream.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    stream = stream.json(path)
    if start_at is not None:
        stream = stream.filter(F.col("_metadata.file_modification_time") >= F.lit(start_at))
    return stream


def drop_recent_copies(events: DataFrame, delay: str = "1 hour", time: str = "timestamp", key: str = "event_id") -> DataFrame:
    """Drop copies of an event id that come within ``delay`` of ``time``, in the stream itself.

    State is bounded by the delay. Rows behind the watermark are dropped as well, so with a time
    that can lag, such as that of the event, late rows are lost; the time of arrival doesn't lag.
    Which of the copies in one micro-batch stays isn't fixed.
    """
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def checked_entries(entries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Decoded entries with their time ``_at`` and whether they are events, ``_ok``."""
    return (
        decode_events(entries, keep)
        .withColumn("_at", F.try_to_timestamp("timestamp"))
        .withColumn("_ok", ~F.col("malformed") & F.col("_at").isNotNull() & (F.col("event_id") != "") & F.col("seq").isNotNull())
    )


class Batch(NamedTuple):
    """A stored batch. Detectors go through its own rows up to ``upto``, and through those of earlier
    batches from ``since`` to ``upto``."""

    number: int
    lo: datetime
    hi: datetime
    since: datetime | None
    upto: datetime


class Pipeline:
    """Handles the micro-batches of one log."""

    def __init__(
        self,
        spark: SparkSession,
        layout: Layout,
        load_rules: Callable[[], DataFrame] | None = None,
        profiles: DataFrame | None = None,
        severity: str = zscore.DEFAULT_SEVERITY,
        late_seconds: float = LATE_SECONDS,
        since_created: bool = False,
        settle_seconds: float = 0,
        evaluate_copies: bool = False,
    ):
        """Without ``profiles`` the default one is used; an empty table turns spikes off. With
        ``since_created`` a new rule starts with an empty window. Detection stays ``settle_seconds``
        behind the newest event: arrivals out of order by no more than that give the
        same result as in order. With ``evaluate_copies`` detectors see copies of an event as
        events of their own; the event is stored once all the same."""
        self.since_created, self.evaluate_copies = since_created, evaluate_copies
        self.spark, self.layout, self.severity, self.late_seconds = spark, layout, severity, late_seconds
        self.settle = timedelta(seconds=settle_seconds)
        self.load_rules = load_rules or (lambda: read_rules(spark, layout.rules))
        self.profiles = zscore.profile_control(zscore.default_profiles(spark) if profiles is None else profiles)
        self.profile_reach = self.profiles.rows.agg(
            F.max((F.col("n_buckets") + 2) * F.col("bucket_ms") / 1000).alias("w"),
            F.max(F.col("cooldown_ms") / 1000).alias("c"),
        ).first()
        self.rules: tuple[Control, Row] | None = None
        self._rules_mark: tuple | None = None
        self._rules_folder: str | None = None
        self.detectors = (self.detect_thresholds, self.detect_spikes)
        self._forget()
        layout.create(spark)

    def start(
        self, log_path: str, checkpoint: str, until_caught_up: bool = False, id_delay: str | None = ID_DELAY, **read_options
    ) -> StreamingQuery:
        """Follow the log; with ``until_caught_up``, stop at its present end. ``start_at`` among the
        options skips what was written before.

        Ids that arrived within ``id_delay`` are held in the stream's state, in RocksDB, so that a copy is
        refused without a look at the stored events; None looks there instead.
        """
        self._forget()
        if not folder_exists(self.spark, f"{checkpoint}/offsets") and not self.layout.batches.read(self.spark).isEmpty():
            raise ValueError(f"the tables in {self.layout.root} belong to another checkpoint than {checkpoint}")
        entries = read_log(self.spark, log_path, **read_options).withColumn("arrived", F.col("_metadata.file_modification_time"))
        entries = checked_entries(entries, ("arrived",))
        unseen = id_delay is not None and not self.evaluate_copies
        if unseen:
            content = F.xxhash64("seq", "event_id", "event_type", "source", "timestamp", "payload", "metadata")
            key = F.when(F.col("_ok"), F.concat(F.lit("="), "event_id")).otherwise(F.concat(F.lit("#"), content.cast("string")))
            entries = drop_recent_copies(entries.withColumn("_key", key), id_delay, "arrived", "_key")
        writer = (
            entries.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, batch_id: self._handle(batch, batch_id, unseen))
        )
        with rocksdb(self.spark):
            return (writer.trigger(availableNow=True) if until_caught_up else writer).start()

    def handle(self, entries: DataFrame, batch_id: int) -> None:
        """Store, then detect. A failing detector is logged and blocks neither the
        stored events nor the other detector; its batches stay due."""
        self._handle(checked_entries(entries), batch_id, False)

    def finish(self) -> None:
        """Detect up to the newest stored event, without waiting for what may come before it."""
        if self._due is None:
            self._resume(None)
        if self._newest is None or self._upto == self._newest:
            return
        with scratch(self.spark):
            self._advance(Batch(self._last + 1, self._newest, self._newest, self._upto, self._newest))

    # Batches of the log have even numbers in the tables; what ``finish`` does has odd ones.

    def _handle(self, decoded: DataFrame, batch_id: int, unseen: bool) -> None:
        number = 2 * batch_id
        if self._due is None or number <= self._last:
            self._resume(number)
        try:
            with scratch(self.spark):
                span = self.store(decoded, number, unseen)
                if span is None:
                    self._advance(None)
                else:
                    settled = max(span[1], self._newest or span[1]) - self.settle
                    self._advance(Batch(number, *span, self._upto, max(settled, self._upto or settled)))
        except Exception:
            self._forget()
            raise
        self._again = False  # a batch is repeated only after a start or a failure

    def _forget(self) -> None:
        """What was handled is in the tables; it is read once, when the next batch comes."""
        self._due: dict[str, list[Batch]] | None = None
        self._last, self._oldest, self._newest, self._upto = -1, None, None, None

    def _resume(self, number: int | None) -> None:
        stored = self.layout.batches.read(self.spark)
        self._again = not stored.isEmpty() or not self.layout.events.read(self.spark).isEmpty()
        earlier = stored if number is None else stored.filter(F.col("batch") < number)
        seen = earlier.agg(F.min("lo").alias("lo"), *[F.max(c).alias(c) for c in ("batch", "hi", "upto")]).first()
        self._last = -1 if seen.batch is None else seen.batch
        self._oldest, self._newest, self._upto = (None if x is None else utc(x) for x in (seen.lo, seen.hi, seen.upto))
        names = [detect.__name__ for detect in self.detectors]
        done = F.array_distinct(F.flatten(F.collect_list("done")))
        left = earlier.groupBy("batch").agg(*[F.max(c).alias(c) for c in ("lo", "hi", "since", "upto")], done.alias("done")).filter(
            F.size(F.array_except(F.array(*map(F.lit, names)), "done")) > 0).orderBy("batch").collect()
        self._due = {name: [
            Batch(r.batch, *(None if x is None else utc(x) for x in (r.lo, r.hi, r.since, r.upto))) for r in left if name not in r.done
        ] for name in names}

    def _advance(self, batch: Batch | None) -> None:
        """Take a stored batch into account, detect, and note which detectors are through with what."""
        if batch is not None:
            for due in self._due.values():
                due.append(batch)
            self._last, self._newest, self._upto = batch.number, max(batch.hi, self._newest or batch.hi), batch.upto
            self._oldest = min(batch.lo, self._oldest or batch.lo)
        through: dict[Batch, list[str]] = {} if batch is None else {batch: []}
        for detect in self.detectors:
            due = self._due[detect.__name__]
            while due:
                try:
                    self._run(detect, due[0], self._again or due[0] != batch)
                except Exception:
                    log.exception("batch %s: %s failed", due[0].number, detect.__name__)
                    break  # later batches need this one's fires
                through.setdefault(due.pop(0), []).append(detect.__name__)
        if through:
            rows = [(*b, names) for b, names in through.items()]
            self.layout.batches.note(self.spark.createDataFrame(rows, BATCHES), self._last)

    def _run(self, detect: Callable, batch: Batch, again: bool) -> None:
        lo = min(batch.lo, batch.since or batch.lo)
        settled = batch.since is None or batch.upto > batch.since or batch.lo <= batch.upto
        if not settled or batch.upto < max(lo, self._oldest):
            return
        rest = F.lit(False) if batch.since is None else F.col("timestamp") > F.lit(batch.since)
        # Events before ``lo`` are there for the windows only; the others are decided now unless they were earlier.
        fresh = (F.col("timestamp") >= F.lit(lo)) & ((F.col("batch_id") == batch.number) | rest)
        found = detect(fresh, lo, batch.upto, batch.number)
        if found is not None:
            self._put(self.layout.anomalies, self._named(found), batch.number, again)

    def _put(self, table: Table, rows: DataFrame, number: int, again: bool, unseen: bool = True) -> None:
        """Append rows of a batch; what may have been written before is looked for."""
        if again or not unseen:
            table.append_new(rows, number, unseen)
        else:
            table.append(rows, number)

    def store(self, decoded: DataFrame, number: int, unseen: bool = False) -> tuple[datetime, datetime] | None:
        """Insert the events of a batch that are new; park entries that are no events.
        Returns the time range of its events."""
        # The stream's own session has no adaptive execution, without which tables aren't gathered by day.
        decoded = checkpointed(decoded, self.spark)
        limit = None if self._newest is None else self._newest - timedelta(seconds=self.late_seconds)
        ok, late = F.col("_ok"), F.col("_at") < F.lit(limit).cast("timestamp")
        seen = decoded.agg(
            F.count_if(~ok).alias("bad"), F.count_if(ok & late).alias("late"),
            F.min(F.when(ok, F.col("_at"))).alias("lo"), F.max(F.when(ok, F.col("_at"))).alias("hi"),
        ).first()
        if seen.bad:
            self._put(self.layout.parked, decoded.filter(~ok), number, self._again)
        if seen.lo is None:
            return None
        rows = (
            decoded.filter("_ok")
            .drop("timestamp")
            .withColumnRenamed("_at", "timestamp")
            .withColumn("created_at", F.current_timestamp())
            .select(*self.layout.events.schema.fieldNames())
        )
        events = dedup_events(rows)
        if seen.late:
            self._put(self.layout.late, events.filter(F.col("timestamp") < F.lit(limit)), number, self._again, unseen)
        self._put(self.layout.events, events, number, self._again, unseen)
        if self.evaluate_copies:
            arrived = rows.select(*self.layout.arrivals.schema.fieldNames())
            self._put(self.layout.arrivals, arrived.dropDuplicates(["event_id", "seq"]), number, True, False)
        return utc(seen.lo), utc(seen.hi)

    def current_rules(self) -> tuple[Control, Row] | None:
        """The rules as of now, and how far they reach back; the previous ones where they are the same or can't be read."""
        try:
            loaded = self.load_rules()
            mark = tuple(loaded.agg(F.count("*"), F.sum(F.xxhash64(*loaded.columns).cast("decimal(38,0)"))).first())
            if self.rules is None or mark != self._rules_mark:
                folder, old = shared_folder(self.spark, "rules"), self._rules_folder
                with tables_in(folder):
                    control = threshold.rule_control(loaded, self.since_created)
                reach = control.rows.agg((F.max("window_ms") / 1000).alias("w"), (F.max("cooldown_ms") / 1000).alias("c")).first()
                self.rules, self._rules_mark, self._rules_folder = (control, reach), mark, folder
                if old is not None:
                    delete_folder(self.spark, old)
        except Exception:
            log.exception("rules not reloaded")
        return self.rules

    def detect_thresholds(self, fresh: Column, lo: datetime, hi: datetime, number: int) -> DataFrame | None:
        current = self.current_rules()
        if current is None or current[1].w is None:
            return None
        rules, reach = current
        found = threshold.threshold_candidates(self.history(lo, hi, reach.w, number), rules, fresh=fresh)
        return threshold.threshold_fires(found, rules, self.earlier_fires("rule_id", lo, hi, reach.c, number))

    def detect_spikes(self, fresh: Column, lo: datetime, hi: datetime, number: int) -> DataFrame | None:
        if self.profile_reach.w is None:
            return None
        found = zscore.zscore_candidates(self.history(lo, hi, self.profile_reach.w, number), self.profiles, fresh=fresh)
        fires = zscore.zscore_fires(
            found, self.profiles, self.severity,
            earlier=self.earlier_fires("profile_id", lo, hi, self.profile_reach.c, number),
        )
        return fires.drop("details")

    def seen(self, lo: datetime, hi: datetime, number: int) -> DataFrame:
        """What detectors see of the batches up to this one, in a time range."""
        table = self.layout.arrivals if self.evaluate_copies else self.layout.events
        rows = table.read(self.spark, lo, hi).filter(F.col("batch_id") <= number)
        if self.evaluate_copies:
            rows = rows.withColumn("event_id", F.concat_ws(COPY_MARK, "event_id", "seq"))
        return rows

    def _named(self, found: DataFrame) -> DataFrame:
        """Anomalies by the event's own id; copies keep an anomaly id of their own."""
        if self.evaluate_copies:
            found = found.withColumn("event_id", F.substring_index("event_id", COPY_MARK, 1))
        return found

    def history(self, lo: datetime, hi: datetime, seconds: float, number: int) -> DataFrame:
        """Stored events up to this batch that its windows can see."""
        return self.seen(lo - timedelta(seconds=seconds), hi, number)

    def earlier_fires(self, key: str, lo: datetime, hi: datetime, cooldown_seconds: float, number: int) -> DataFrame:
        """When each rule fired, from anomalies of earlier batches that can hold back a candidate."""
        earlier = self.layout.anomalies.read(self.spark, lo - timedelta(seconds=cooldown_seconds), hi).filter(
            F.col("batch_id") < number
        )
        return earlier.select(F.col("rule_id").alias(key), F.unix_millis("detected_at").alias("fire_ms"))


def notify(
    spark: SparkSession, layout: Layout, checkpoint: str, config: dict | None = None, until_caught_up: bool = False
) -> StreamingQuery:
    """Second query: stored anomalies to the notification outbox."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(layout.anomalies.schema.fieldNames()).dropDuplicates(["anomaly_id"])
        layout.outbox.append_new(outbox.notification_outbox(rows, config), batch_id)

    anomalies = layout.anomalies
    stored = anomalies.read(spark).schema
    writer = (
        spark.readStream.schema(stored)
        .parquet(anomalies.path)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(handle)
    )
    return (writer.trigger(availableNow=True) if until_caught_up else writer).start()

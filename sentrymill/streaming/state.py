"""Detectors as state operators: one streaming query from events to anomalies.

State is kept per rule and time block, so that no rule is one key: an event goes to the state of
its own block and to that of the blocks whose windows or baselines see it. A second operator
holds the last fire of each rule and applies the cooldown to the few rows that meet the
condition. State of a block goes once the watermark has passed what can still need it.

The state operator handles row by row, so events come to it in packs: blocks are dealt over slots by a hash, a
row holds many events of a slot, and a slot keeps the states of its blocks and which events are late.

Rows of a micro-batch are taken in the order of event time and ``seq``. An event that comes after
later ones counts those stored that are not later than itself; one behind the watermark is dropped by
these operators (``Pipeline`` stores and lists it as late). The state store has to be RocksDB
(``with rocksdb(spark)`` around the start).
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import threshold, zscore
from ..operators.cooldown import walk
from ..operators.joins import Control, match_filters
from ..sources.tables import with_ms

DELAY = "1 hour"
# Runs of times in a window's state before they are merged into one.
MERGE_RUNS = 64
# Blocks are at least so wide, and those of the z-score state as many times what a baseline reaches back.
BLOCK_MS = 3_600_000
BLOCK_REACHES = 4
# Slots that blocks are dealt over (fixed over the life of a checkpoint), and rows packed at a time.
SLOTS = 512
PACK_ROWS = 200_000

# The six comparisons; rules with another operator never fire.
OPERATORS = {">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal, "==": np.equal, "!=": np.not_equal}

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streaming queries started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _sorted(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(["ts_ms", "seq"], kind="stable", ignore_index=True)


class WindowCounts(StatefulProcessor):
    """Sliding count of a rule in one block, which is at least as wide as the window.

    State: the times of the events of this block and of the window before it, as runs of distinct
    milliseconds with how many events each has; a run is added per micro-batch.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "times binary, counts binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _sorted(rows)
        window = int(new.window_ms[0])
        times, counts, n = self._stored()
        at = new.ts_ms.to_numpy()
        stored = np.concatenate(([0], np.cumsum(counts)))
        seen = stored[np.searchsorted(times, at, "right")] - stored[np.searchsorted(times, at - window, "left")]
        count = seen + np.arange(1, len(at) + 1) - np.searchsorted(at, at - window, "left")
        self._add(*np.unique(at, return_counts=True), times, counts, n)
        end = (int(key[1]) + 1) * int(new.width[0])
        if end > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(end)
        hit = np.asarray(new.own, bool) & OPERATORS[new.operator[0]](count, new.value.to_numpy())
        if new.cooldown_ms[0] > 0:  # later ones in the same millisecond can't fire
            first = np.zeros(len(at), bool)
            first[np.flatnonzero(hit)[np.unique(at[hit], return_index=True)[1]]] = True
            hit = first
        if hit.any():
            yield new[hit].assign(count=count[hit])[["rule_id", "cooldown_ms", "event_id", "ts_ms", "seq", "count", "timestamp"]]

    def _stored(self) -> tuple[np.ndarray, np.ndarray, int]:
        runs = [(np.frombuffer(t, np.int64), np.frombuffer(c, np.int64)) for t, c in self.runs.get()]
        if not runs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        times, counts = (np.concatenate(x) for x in zip(*runs))
        order = np.argsort(times, kind="stable")
        return times[order], counts[order], len(runs)

    def _add(self, times, counts, old_times, old_counts, n) -> None:
        if n < MERGE_RUNS:
            self.runs.appendValue((times.tobytes(), counts.tobytes()))
            return
        times, place = np.unique(np.concatenate((old_times, times)), return_inverse=True)
        total = np.zeros(len(times), np.int64)
        np.add.at(total, place, np.concatenate((old_counts, counts)))
        self.runs.put([(times.tobytes(), total.tobytes())])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.runs.clear()
        return iter(())


class BucketCounts(StatefulProcessor):
    """Running counts and baselines of a profile in one block of buckets. State: count by bucket,
    for the block and as many buckets before it as a baseline reaches back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "bucket long", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _sorted(rows)
        width, n = int(new.bucket_ms[0]), int(new.n_buckets[0])
        total = {int(k[0]): int(v[0]) for k, v in self.counts.iterator()}
        before = dict(total)
        bucket = new.bucket.to_numpy()
        changed, at, counts = np.unique(bucket, return_index=True, return_counts=True)
        for b, more in zip(changed.tolist(), counts.tolist()):
            total[b] = total.get(b, 0) + more
            self.counts.updateValue((b,), (total[b],))
        watermark = timerValues.getCurrentWatermarkInMs()
        for b in total:  # no event to come reaches back so far
            if (b + n + 2) * width <= watermark:
                self.counts.removeKey((b,))
        end = (int(key[1]) + 1) * BLOCK_REACHES * (n + 1) * width
        if end > watermark:
            self.handle.registerTimer(end)

        known = np.array(sorted(total), np.int64)
        found = []
        for b, first, more in zip(changed.tolist(), at.tolist(), counts.tolist()):
            past = known[np.searchsorted(known, b - n - 1):np.searchsorted(known, b)][-n:]
            if not new.own[first] or len(past) < n:
                continue
            base = [float(total[int(k)]) for k in past]
            mean = _fold(base) / n
            stddev = (_fold([(x - mean) * (x - mean) for x in base]) / n) ** 0.5
            if stddev <= 0:
                continue
            current = before.get(b, 0) + np.arange(1, more + 1)
            z = (current - mean) / stddev
            hit = np.flatnonzero(z >= new.z_threshold[0])
            found.append(new.iloc[first + hit].assign(
                current=current[hit], mean=mean, stddev=stddev, z=z[hit], bucket_start_ms=b * width))
        if found:
            yield pd.concat(found)[[
                "profile_id", "cooldown_ms", "event_id", "ts_ms", "seq", "current", "mean", "stddev", "z", "bucket_start_ms",
                "timestamp"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        return iter(())


class BlockState:
    """What the processor of one block sees as its handle and state; ``held`` is its list or map."""

    def __init__(self, held: list | dict):
        self.held, self.end = held, 0

    def getListState(self, *_):
        return self

    getMapState = getListState

    def registerTimer(self, at: int) -> None:
        self.end = at

    def get(self) -> Iterator[tuple]:
        return iter(self.held)

    def appendValue(self, value: tuple) -> None:
        self.held.append(value)

    def put(self, values: list[tuple]) -> None:
        self.held = values

    def iterator(self) -> Iterator[tuple]:
        return iter(list(self.held.items()))

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.held[key] = value

    def removeKey(self, key: tuple) -> None:
        del self.held[key]


class Slot(StatefulProcessor):
    """The blocks of one slot, each handled by ``kind`` as if it were a key of its own.

    Events behind the watermark of the micro-batch before are late and dropped, as Spark drops rows. Every slot is
    called in each micro-batch, by a pack or by a timer, and so knows that watermark. State: it, and by
    block what its processor holds and when it ends.
    """

    def __init__(self, kind: type, key: str, empty: type):
        self.kind, self.key, self.empty = kind, key, empty

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "ms long")
        self.blocks = handle.getMapState("blocks", "block string", "held binary")
        self.ends = handle.getMapState("ends", "block string", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        noted = self.clock.get()
        late = int(noted[0]) if noted else 0
        self._tick(timerValues)
        packs = [pa.ipc.open_stream(body).read_all() for some in rows for body in some.body if body is not None]
        if not packs:
            return
        events = pa.concat_tables(packs)
        on_time = pc.greater(events.column("timestamp").cast(pa.int64()), late * 1000)
        events = events.filter(pc.fill_null(on_time, True)).to_pandas()
        found = []
        for block, new in events.groupby([self.key, "block"], sort=False, dropna=False):
            found += self._block(block, new, timerValues)
        if found:
            yield pd.concat(found, ignore_index=True)

    def _block(self, block: tuple, new: pd.DataFrame, timerValues) -> list[pd.DataFrame]:
        name = (json.dumps([block[0], int(block[1])]),)
        stored = self.blocks.getValue(name)
        state = BlockState(pickle.loads(stored[0]) if stored else self.empty())
        processor = self.kind()
        processor.init(state)
        found = list(processor.handleInputRows(block, iter([new]), timerValues))
        self.blocks.updateValue(name, (pickle.dumps(state.held),))
        if not stored:
            self.ends.updateValue(name, (state.end,))
        return found

    def _tick(self, timerValues) -> None:
        """Note the watermark, to be called when it moves."""
        now = timerValues.getCurrentWatermarkInMs()
        self.clock.update((now,))
        self.handle.registerTimer(now + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._tick(timerValues)
        watermark = timerValues.getCurrentWatermarkInMs()
        for name in [name for name, end in self.ends.iterator() if end[0] <= watermark]:
            self.ends.removeKey(name)
            self.blocks.removeKey(name)
        return iter(())


def _fold(values: list[float]) -> float:
    """Sum from the left: results at the exact threshold depend on the order."""
    total = 0.0
    for v in values:
        total += v
    return total


class LastFire(StatefulProcessor):
    """The cooldown: a candidate fires if the last fire is at least the cooldown ago. State: its time.
    ``first_fire_ms`` is a fire that every key had."""

    def __init__(self, first_fire_ms: int | None = None):
        self.first_fire_ms = first_fire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _sorted(rows)
        cooldown = int(new.cooldown_ms[0])
        if cooldown > 0:
            last = int(self.last.get()[0]) if self.last.exists() else self.first_fire_ms
            times, first = np.unique(new.ts_ms.to_numpy(), return_index=True)
            fired = walk(times, cooldown, *([] if last is None else [last + cooldown]))
            if not len(fired):
                return
            self.last.update((int(fired.max()),))
            new = new.iloc[first[np.searchsorted(times, np.sort(fired))]]
        yield new


# ---- streams -------------------------------------------------------------------------------


def _spread(rows: DataFrame, own: Column, seen_later: Column) -> DataFrame:
    """Each row with its ``block``, and in the next one (not ``own`` there) where that looks back on it."""
    blocks = F.when(seen_later, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.withColumn("_own", own).withColumn("block", F.explode(blocks)).withColumn("own", F.col("block") == F.col("_own"))


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of events by ``slot``, each with many of them in Arrow's format. The first task also sends a row without
    events to every slot."""
    if TaskContext.get().partitionId() == 0:
        yield pa.RecordBatch.from_pydict({"slot": pa.array(range(SLOTS), pa.int32()), "body": pa.nulls(SLOTS, pa.binary())})
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACK_ROWS:
            yield _packed(held)
            held, n = [], 0
    if n:
        yield _packed(held)


def _packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    events = pa.Table.from_batches(batches).combine_chunks()
    slot = events.column("slot").to_numpy()
    order = np.argsort(slot, kind="stable")
    events, slot = events.drop_columns("slot").take(pa.array(order)), slot[order]
    slots, first, size = np.unique(slot, return_index=True, return_counts=True)
    bodies = []
    for a, n in zip(first.tolist(), size.tolist()):
        body = pa.BufferOutputStream()
        with pa.ipc.new_stream(body, events.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_table(events.slice(a, n))
        bodies.append(body.getvalue().to_pybytes())
    return pa.RecordBatch.from_pydict({"slot": pa.array(slots, pa.int32()), "body": pa.array(bodies, pa.binary())})


def _candidates(spread: DataFrame, key: str, kind: type, empty: type, schema: str) -> DataFrame:
    """What the processors of ``kind`` give, of the blocks of each ``key``."""
    slot = F.pmod(F.xxhash64(key, "block"), F.lit(SLOTS)).cast("int").alias("slot")
    packs = spread.select(slot, "*").mapInArrow(_packs, "slot int, body binary")
    return packs.groupBy("slot").transformWithStateInPandas(
        Slot(kind, key, empty), schema, "Append", "EventTime", eventTimeColumnName="timestamp")


def _fires(candidates: DataFrame, key: str, block: Column, schema: str, first_fire_ms: int | None = None) -> DataFrame:
    """The candidates that fire. Without a cooldown there is no order to keep, so blocks stay apart."""
    slot = F.when(F.col("cooldown_ms") > 0, F.lit(0)).otherwise(block).cast("long")
    return candidates.withColumn("_slot", slot).groupBy(key, "_slot").transformWithStateInPandas(
        LastFire(first_fire_ms), schema, "Append", "None").drop("timestamp")


def threshold_stream(events: DataFrame, rules: DataFrame | Control, delay: str = DELAY) -> DataFrame:
    """Threshold anomalies of a stream of events, as ``threshold_anomalies`` gives them of a table.

    ``delay``: how far behind the newest event one may come. Rules are those at the start of the query.
    """
    control = threshold.rule_control(rules)
    slim = with_ms(events).withWatermark("timestamp", delay).select("event_id", "event_type", "source", "timestamp", "ts_ms", "seq")
    matched = match_filters(slim, control, ["rule_id", "window_ms", "since_ms", "cooldown_ms", "operator", "value"]).where(
        (F.col("since_ms").isNull() | (F.col("ts_ms") >= F.col("since_ms"))) & F.col("operator").isin(*OPERATORS))
    width = F.greatest(F.col("window_ms"), F.lit(BLOCK_MS)).cast("long")
    own = F.floor(F.col("ts_ms") / width)
    seen_later = F.pmod(F.col("ts_ms"), width) >= width - F.col("window_ms")
    spread = _spread(matched.withColumn("width", width), own, seen_later).select(
        "rule_id", "block", "own", "width", "window_ms", "cooldown_ms", "operator", "value", "event_id", "ts_ms", "seq", "timestamp")
    schema = "rule_id string, cooldown_ms long, event_id string, ts_ms long, seq long, count long, timestamp timestamp"
    candidates = _candidates(spread, "rule_id", WindowCounts, list, schema)
    fired = _fires(candidates, "rule_id", F.floor(F.col("ts_ms") / 60_000), schema, first_fire_ms=0)
    return threshold.threshold_rows(fired, control)


def zscore_stream(
    events: DataFrame, profiles: DataFrame | Control, delay: str = DELAY, severity: str = zscore.DEFAULT_SEVERITY,
    rule_id_prefix: str = "",
) -> DataFrame:
    """Z-score anomalies of a stream of events, as ``zscore_anomalies`` gives them of a table."""
    control = zscore.profile_control(profiles)
    slim = with_ms(events).withWatermark("timestamp", delay).select("event_id", "event_type", "source", "timestamp", "ts_ms", "seq")
    matched = match_filters(slim, control, ["profile_id", "bucket_ms", "n_buckets", "z_threshold", "cooldown_ms"]).withColumn(
        "bucket", F.floor(F.col("ts_ms") / F.col("bucket_ms")))
    reach = F.col("n_buckets") + 1
    width = reach * BLOCK_REACHES
    own = F.floor(F.col("bucket") / width)
    in_tail = F.pmod(F.col("bucket"), width) >= width - reach
    spread = _spread(matched, own, in_tail).select(
        "profile_id", "block", "own", "bucket", "bucket_ms", "n_buckets", "z_threshold", "cooldown_ms", "event_id", "ts_ms", "seq", "timestamp")
    schema = (
        "profile_id string, cooldown_ms long, event_id string, ts_ms long, seq long, current long, mean double, "
        "stddev double, z double, bucket_start_ms long, timestamp timestamp")
    candidates = _candidates(spread, "profile_id", BucketCounts, dict, schema)
    fired = _fires(candidates, "profile_id", F.floor(F.col("ts_ms") / 60_000), schema)
    return zscore.zscore_rows(fired, control, severity, rule_id_prefix)

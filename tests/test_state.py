"""State operators, rollups and the rule stream against their batch forms."""

import random
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import functions as F

from sentrymill.operators import metrics, rules, threshold, zscore
from sentrymill.plans import catalog
from sentrymill.sources import codec
from sentrymill.streaming import rollups, rule_changes, state
from sentrymill.streaming.pipeline import read_log

from .fixtures import T0, event_frame, make_events, profile_frame, rule_frame
from .test_streaming import PROFILES, RULES, write_log


def follow(stream, root):
    writer = stream.writeStream.format("parquet").option("path", f"{root}/found").option("checkpointLocation", f"{root}/offsets")
    with state.rocksdb(stream.sparkSession):
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query.recentProgress


def events_of(spark, log):
    entries = codec.decode_events(read_log(spark, log, 1))
    return entries.withColumn("timestamp", F.to_timestamp("timestamp"))


def test_detectors_over_a_restart(spark, tmp_path):
    events = make_events(n=240, grain_ms=1000)
    made, profiles = rule_frame(spark, RULES), profile_frame(spark, PROFILES)
    for name, make, want in (
        ("t", lambda ev: state.threshold_stream(ev, made, "10 minutes"), threshold.threshold_anomalies(event_frame(spark, events), made)),
        ("z", lambda ev: state.zscore_stream(ev, profiles, "10 minutes").drop("details"),
         zscore.zscore_anomalies(event_frame(spark, events), profiles).drop("details")),
    ):
        log, root = str(tmp_path / f"log{name}"), str(tmp_path / name)
        for part in (events[:70], events[70:]):
            for k in range(0, len(part), 90):
                write_log(log, part[k:k + 90], f"{part[k]['seq']:06d}")
            follow(make(events_of(spark, log)), root)
        assert sorted(map(tuple, spark.read.parquet(f"{root}/found").collect())) == sorted(map(tuple, want.collect()))


class Cell:
    """A state variable of one key."""

    def __init__(self):
        self.value, self.map = None, {}

    def exists(self):
        return self.value is not None

    def get(self):
        return iter(self.value or []) if isinstance(self.value, list) or self.value is None else self.value

    def update(self, value):
        self.value = value

    put = update

    def appendValue(self, value):
        self.value = [*(self.value or []), value]

    def clear(self):
        self.value, self.map = None, {}

    def iterator(self):
        return iter(list(self.map.items()))

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]


class Handle:
    def __init__(self):
        self.timers, self.cell = [], Cell()

    def getListState(self, *_):
        return self.cell

    getMapState = getValueState = getListState

    def registerTimer(self, at):
        self.timers.append(at)


class Watermark:
    def __init__(self, at=0):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def started(processor):
    handle = Handle()
    processor.init(handle)
    return processor, handle


def window_rows(times, first_seq, window=1000, operator=">", value=0.0, cooldown=0, own=True):
    return pd.DataFrame({
        "rule_id": "r", "block": 0, "own": own, "width": 3_600_000, "window_ms": window, "cooldown_ms": cooldown, "operator": operator,
        "value": value, "event_id": [f"e{first_seq + k}" for k in range(len(times))], "ts_ms": times,
        "seq": np.arange(first_seq, first_seq + len(times)), "timestamp": pd.to_datetime(times, unit="ms")})


def test_window_counts_merge_runs_and_keep_ties():
    rng = random.Random(3)
    times = sorted(rng.randrange(20_000) // 50 * 50 for _ in range(700))
    processor, handle = started(state.WindowCounts())
    found = []
    for k in range(0, len(times), 7):
        rows = window_rows(times[k:k + 7], k).sample(frac=1, random_state=k)
        found += [x for df in processor.handleInputRows(("r", 0), iter([rows[:3], rows[3:]]), Watermark()) for x in zip(df.seq, df["count"])]
    want = [(k, sum(t - 1000 <= x <= t for x in times[:k + 1])) for k, t in enumerate(times)]
    assert sorted(found) == want
    assert len(handle.cell.value) <= state.MERGE_RUNS
    assert set(handle.timers) == {3_600_000}
    list(processor.handleExpiredTimer(("r", 0), Watermark(), None))
    assert handle.cell.value is None


def test_window_counts_take_only_own_rows_and_one_per_millisecond():
    processor, _ = started(state.WindowCounts())
    rows = pd.concat([window_rows([10, 10], 0, own=False, cooldown=5), window_rows([500, 500, 600], 2, cooldown=5)])
    out = pd.concat(processor.handleInputRows(("r", 0), iter([rows]), Watermark()))
    assert out[["event_id", "count"]].values.tolist() == [["e2", 3], ["e4", 5]]
    assert not list(processor.handleInputRows(("r", 0), iter([window_rows([700], 9, operator="<")]), Watermark()))


def test_last_fire_holds_back_over_batches():
    processor, handle = started(state.LastFire(0))
    rows = lambda times: window_rows(times, 0, cooldown=100)
    fired = lambda times: [x for df in processor.handleInputRows(("r", 0), iter([rows(times)]), Watermark()) for x in df.ts_ms]
    assert fired([50]) == [] and fired([90, 100, 150, 199, 200]) == [100, 200]
    assert fired([299]) == [] and fired([300, 301]) == [300] and handle.cell.value == (300,)


def test_bucket_counts_forget_what_no_baseline_reaches():
    processor, handle = started(state.BucketCounts())
    rows = lambda buckets, first: pd.DataFrame({
        "profile_id": "p", "block": 0, "own": True, "bucket": buckets, "bucket_ms": 10, "n_buckets": 2, "z_threshold": 1.0,
        "cooldown_ms": 0, "event_id": "e", "ts_ms": [b * 10 for b in buckets], "seq": range(first, first + len(buckets)),
        "timestamp": pd.to_datetime(0)})
    out = list(processor.handleInputRows(("p", 0), iter([rows([0, 1, 1, 1], 0)]), Watermark()))
    assert not out
    out = pd.concat(processor.handleInputRows(("p", 0), iter([rows([2] * 5, 4)]), Watermark(40)))
    assert out.current.tolist() == [3, 4, 5] and set(out["mean"]) == {2.0} and set(out.stddev) == {1.0}
    assert {k[0] for k in handle.cell.map} == {1, 2} and handle.timers[0] == 120


class SlotHandle:
    """A state variable per name; those without a value give None, as Spark's do."""

    def __init__(self):
        self.timers, self.cells = [], {}

    def getValueState(self, name, _):
        cell = self.cells.setdefault(name, Cell())
        cell.get = lambda: cell.value
        return cell

    def getMapState(self, name, *_):
        cell = self.cells.setdefault(name, Cell())
        cell.getValue = cell.map.get
        return cell

    def registerTimer(self, at):
        self.timers.append(at)


def packed(rows):
    table = pa.Table.from_pandas(rows.assign(slot=3), preserve_index=False).set_column(
        rows.columns.get_loc("timestamp"), "timestamp", pa.array(rows.timestamp, pa.timestamp("us")))
    batch = state._packed(table.to_batches())
    assert batch.column("slot").to_pylist() == [3]
    return batch.to_pandas()


def test_slots_take_packs_and_drop_what_is_behind_the_last_watermark():
    slot, handle = state.Slot(state.WindowCounts, "rule_id", list), SlotHandle()
    slot.init(handle)
    run = lambda times, first, at: [x for df in slot.handleInputRows((3,), iter([packed(window_rows(times, first))]), Watermark(at)) for x in zip(df.seq, df["count"])]
    assert run([100, 200, 200], 0, 0) == [(0, 1), (1, 2), (2, 3)]
    assert run([300], 3, 250) == [(3, 4)]
    # 250 is the watermark of the micro-batch before: what isn't after it is dropped, what is behind the newest one isn't
    assert run([260, 240, 250, 700], 4, 600) == [(4, 4), (7, 6)]
    assert not list(slot.handleInputRows((3,), iter([pd.DataFrame({"slot": [3], "body": [None]})]), Watermark(650)))
    assert run([650, 651], 8, 800) == [(9, 6)]
    assert handle.timers == [1, 251, 601, 651, 801]


def test_slots_know_the_watermark_from_timers_and_clear_blocks():
    slot, handle = state.Slot(state.BucketCounts, "profile_id", dict), SlotHandle()
    slot.init(handle)
    rows = pd.DataFrame({
        "profile_id": ["p", "p", "q"], "block": 0, "own": True, "bucket": [0, 1, 1], "bucket_ms": 10, "n_buckets": [2, 2, 9], "z_threshold": 1.0,
        "cooldown_ms": 0, "event_id": "e", "ts_ms": [1, 10, 10], "seq": range(3), "timestamp": pd.to_datetime([1, 10, 10], unit="ms")})
    assert not list(slot.handleInputRows((3,), iter([packed(rows)]), Watermark()))
    assert len(handle.cells["blocks"].map) == 2
    assert not list(slot.handleExpiredTimer((3,), Watermark(120), None))
    assert list(handle.cells["blocks"].map) == list(handle.cells["ends"].map) == [('["q", 0]',)]
    assert handle.cells["clock"].value == (120,) and handle.timers == [1, 121]


def test_late_events_over_a_stream(spark, tmp_path):
    """Parts that each span all times: what is behind the watermark of the micro-batch before is left out."""
    events = make_events(n=240, grain_ms=1000)
    parts = [events[k::4] for k in range(4)]
    made = rule_frame(spark, [("r", "any", True, "info", 60, 0, None, None, ">=", 1)])
    log, root = str(tmp_path / "log"), str(tmp_path / "out")
    for k, part in enumerate(parts):
        write_log(log, part, f"{k:06d}")
    follow(state.threshold_stream(events_of(spark, log), made, "10 minutes"), root)
    newest, kept = [max(e["ts_ms"] for e in part) for part in parts], set()
    for k, part in enumerate(parts):
        late = max(newest[:k - 1]) - 600_000 if k > 1 else 0
        kept |= {e["event_id"] for e in part if e["ts_ms"] > late}
    assert 120 < len(kept) < 240
    assert {r.event_id for r in spark.read.parquet(f"{root}/found").collect()} == kept


def test_parts_have_more_files_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(catalog, "FILE_ROWS", 7)
    events = event_frame(spark, make_events(n=240))
    sizes, follow_on = [], catalog._follow

    def counted(stream, root):
        sizes.append(len(spark.read.text(f"{root}/log").inputFiles()))
        follow_on(stream, root)

    monkeypatch.setattr(catalog, "_follow", counted)
    seen = catalog._run_stream(spark, catalog._parts(events), lambda ev: ev.select("event_id", "seq"))
    assert sizes == [4 * 5, 8 * 5]
    assert seen.distinct().count() == seen.count() == 240


def test_rule_stream_equals_fold_of_the_log(spark, tmp_path):
    rng = random.Random(11)
    rows = []
    for seq in range(400):
        reason = rng.choice(["create", "update", "patch", "patch", "delete"])
        pick = lambda v: v if reason in ("create", "update") or rng.random() < 0.4 else None
        rows.append((f"r{rng.choice('aabcdefgh')}", seq, T0 + timedelta(seconds=seq), reason, pick(f"n{seq}"), pick(seq % 2 == 0),
                     pick("info"), pick(seq), pick(seq + 1), pick(("threshold", "count", (None, rng.choice([None, "s"])), ">", seq / 7))))
    schema = "rule_id string, seq long, at timestamp, reason string, name string, enabled boolean, severity string, " \
             "window_seconds int, cooldown_seconds int, condition struct<type:string,metric:string,filters:struct<event_type:string,source:string>,operator:string,value:double>"
    log = spark.createDataFrame(rows, schema)
    root = str(tmp_path)
    for lo, hi in ((0, 150), (150, 400)):
        for a in range(lo, hi, 50):
            log.filter((F.col("seq") >= a) & (F.col("seq") < a + 50)).coalesce(1).write.mode("append").parquet(f"{root}/log")
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/log")
        follow(rule_changes.rule_states(stream), root)
    found = rule_changes.current_rules(spark.read.parquet(f"{root}/found"))
    want = rules.apply_rule_changes(log)
    assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert 0 < want.count() < 8


def test_window_edges_are_counted_from_events(spark):
    events = event_frame(spark, make_events(n=900))
    rollup = events.groupBy(F.date_trunc("minute", "timestamp").alias("minute"), "event_type", "source").agg(F.count("*").alias("count"))
    half = rollup.filter(F.col("minute") < F.lit(T0 + timedelta(minutes=55)))
    for part in (rollup, half, rollup.limit(0)):
        for end, seconds in ((T0 + timedelta(seconds=7000), 3600), (T0 + timedelta(seconds=3661.5), 3600), (T0 + timedelta(seconds=3030), 45), (T0 + timedelta(minutes=60), 600)):
            for options in ({}, {"group_by": "source", "event_type": "error"}, {"source": "hot"}):
                got = rollups.window_metrics(part, events, end, seconds, **options)
                want = metrics.window_metrics(events, end, seconds, **options)
                assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rollup_has_each_sealed_minute_once(spark, tmp_path):
    events = make_events(n=300)
    log = str(tmp_path / "log")
    for k in range(0, 300, 75):
        write_log(log, events[k:k + 75], f"{k:03d}")
    follow(rollups.minute_rollup(events_of(spark, log), "10 minutes"), str(tmp_path))
    found = spark.read.parquet(f"{tmp_path}/found")
    assert found.count() == found.select("minute", "event_type", "source").distinct().count() > 0
    sealed = rollups.sealed_until(found)
    want = event_frame(spark, events).filter(F.col("timestamp") < F.lit(sealed)).groupBy(
        F.date_trunc("minute", "timestamp").alias("minute"), "event_type", "source").count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_wide_baselines_equal_narrow_ones(spark, monkeypatch):
    events = event_frame(spark, make_events(n=900))
    profiles = profile_frame(spark, [("a", 60, 5, 1.5, 0, None, None), ("b", 30, 12, 1.0, 300, "error", None), ("c", 60, 2, 1.0, 0, None, "hot")])
    rows = lambda: sorted(map(tuple, zscore.zscore_baseline(events, profiles).collect()))
    narrow = rows()
    for limit in (0, 4):
        monkeypatch.setattr(zscore, "WIDE_BUCKETS", limit)
        assert rows() == narrow and narrow


def test_one_wide_profile_leaves_the_others_as_they_are(spark):
    events = event_frame(spark, make_events(n=900))
    small = [("a", 60, 5, 1.5, 0, None, None)]
    alone = zscore.zscore_baseline(events, profile_frame(spark, small))
    both = zscore.zscore_baseline(events, profile_frame(spark, [*small, ("wide", 1, 50_000, 1.0, 0, None, None)]))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, alone.collect()))
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "50000" not in plan.split("FlatMapGroupsInArrow")[0]


def test_changes_come_to_the_state_in_packs_without_what_a_delete_ends():
    rows = [("a", 1, "create"), (None, 2, "create"), ("a", 5, "delete"), ("b", 3, "create"), ("a", 4, "patch"), ("a", 6, "create"), ("b", 7, "patch")]
    batch = pa.RecordBatch.from_pydict({
        "rule_id": pa.array([r[0] for r in rows], pa.string()), "seq": [r[1] for r in rows], "at_us": [10 * r[1] for r in rows],
        "reason": [r[2] for r in rows], "fields": [f'{{"name":"{r[1]}"}}' for r in rows]})
    got = [r for b in rule_changes.pack_changes(iter([batch])) for r in b.to_pylist()]
    by_rule = {r["rule_id"]: r for r in got}
    assert len(got) == 3 and {k: (r["seq"], r["reason"]) for k, r in by_rule.items()} == {
        "a": ([5, 6], ["delete", "create"]), None: ([2], ["create"]), "b": ([3, 7], ["create", "patch"])}
    assert by_rule["a"]["at_us"] == [50, 60] and by_rule["b"]["fields"] == ['{"name":"3"}', '{"name":"7"}']

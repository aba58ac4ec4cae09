import json
import os
import re
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sentrymill.operators import threshold, zscore
from sentrymill.streaming.pipeline import Pipeline, drop_recent_copies, notify, read_log
from sentrymill.streaming.tables import Layout

from .fixtures import event_frame, make_events, profile_frame, rule_frame

RULES = [
    ("any-cd", "any cd", True, "critical", 300, 600, None, None, ">=", 10),
    ("err", "err", True, "info", 30, 0, "error", None, ">", 2),
    ("hot", "hot", True, "info", 900, 70, None, "hot", ">", 3),
]
PROFILES = [("a", 60, 5, 1.5, 0, None, None), ("b", 120, 3, 1.0, 300, "error", None)]


def write_log(folder, events, name):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as out:
        for e in events:
            at = datetime.fromtimestamp(e["ts_ms"] / 1000, timezone.utc).isoformat(timespec="milliseconds")
            fields = {"event_id": e["event_id"], "event_type": e["event_type"], "source": e["source"],
                      "timestamp": at.replace("+00:00", "Z"), "payload": "{}"}
            out.write(json.dumps({"seq": e["seq"], "fields": fields}) + "\n")


def run(query):
    query.processAllAvailable()
    query.stop()
    assert query.exception() is None


@pytest.fixture
def events():
    return make_events(n=240, grain_ms=1000)


def test_stream_equals_batch_with_restart_and_copies(spark, tmp_path, events):
    log, layout = str(tmp_path / "log"), Layout(str(tmp_path / "out"))
    rules, profiles = rule_frame(spark, RULES), profile_frame(spark, PROFILES)
    make = lambda: Pipeline(spark, layout, load_rules=lambda: rules, profiles=profiles)
    check = str(tmp_path / "check")
    write_log(log, events[:90], f"{0}")
    run(make().start(log, check, files_per_batch=1))
    # a restart with new files, one of them repeating entries already stored
    write_log(log, events[60:170], f"{1}")
    run(make().start(log, check, files_per_batch=1))
    write_log(log, events[170:] + [dict(events[0], seq=999_999)], f"{2}")
    run(make().start(log, check, files_per_batch=1))

    stored = layout.events.read(spark)
    assert stored.count() == len(events) == stored.select("event_id").distinct().count()
    batch = event_frame(spark, events)
    want = {(r.rule_id, r.event_id, r.message) for r in threshold.threshold_anomalies(batch, rules).collect()}
    want |= {(r.rule_id, r.event_id, r.message) for r in zscore.zscore_anomalies(batch, profiles).collect()}
    found = [(r.rule_id, r.event_id, r.message) for r in layout.anomalies.read(spark).collect()]
    assert sorted(found) == sorted(want)
    assert {r[0] for r in found} >= {"any-cd", "hot", "a"}

    run(notify(spark, layout, str(tmp_path / "check2")))
    run(notify(spark, layout, str(tmp_path / "check3")))
    assert layout.outbox.read(spark).count() == 3 * len(found)


def test_replayed_batch_adds_nothing(spark, tmp_path, events):
    layout = Layout(str(tmp_path / "out"))
    write_log(str(tmp_path / "log"), events, "a")
    entries = spark.read.schema(read_log(spark, str(tmp_path / "log")).schema).json(str(tmp_path / "log"))
    pipe = Pipeline(spark, layout, load_rules=lambda: rule_frame(spark, RULES))
    pipe.handle(entries, 0)
    first = layout.anomalies.read(spark).count()
    pipe.handle(entries, 0)
    assert first > 0
    assert layout.anomalies.read(spark).count() == first
    assert layout.events.read(spark).count() == len(events)


def test_failures_keep_events_and_old_rules(spark, tmp_path, events):
    layout = Layout(str(tmp_path / "out"))
    log = tmp_path / "log"
    write_log(str(log), events[:120], "a")
    with open(log / "bad.json", "w") as out:
        out.write(json.dumps({"seq": 1_000_000, "fields": {"event_id": "x", "payload": "{"}}) + "\n")
    entries = spark.read.schema(read_log(spark, str(log)).schema).json(str(log))
    answers = [rule_frame(spark, RULES)]

    def load():
        return answers.pop(0) if answers else 1 / 0

    pipe = Pipeline(spark, layout, load_rules=load)
    pipe.handle(entries, 0)
    assert layout.parked.read(spark).count() == 1
    before = layout.anomalies.read(spark).count()
    write_log(str(tmp_path / "more"), events[120:], "b")
    pipe.handle(spark.read.schema(entries.schema).json(str(tmp_path / "more")), 1)
    assert layout.events.read(spark).count() == len(events)
    assert layout.anomalies.read(spark).count() > before

    broken = Pipeline(spark, Layout(str(tmp_path / "out2")), load_rules=lambda: 1 / 0)
    broken.handle(entries, 0)
    assert broken.layout.events.read(spark).count() == 120
    assert broken.layout.anomalies.read(spark).count() == 0


def test_start_position_and_bounded_dedup(spark, tmp_path, events):
    log = str(tmp_path / "log")
    write_log(log, events[:20], "old")
    old = time.time() - 3600
    os.utime(f"{log}/old.json", (old, old))
    write_log(log, events[20:30] + events[20:25], "new")
    start = datetime.fromtimestamp(time.time() - 600, timezone.utc)
    stream = read_log(spark, log, start_at=start).select(
        F.col("fields")["event_id"].alias("event_id"), F.to_timestamp(F.col("fields")["timestamp"]).alias("timestamp"))
    query = (drop_recent_copies(stream).writeStream.format("memory").queryName("seen")
             .option("checkpointLocation", str(tmp_path / "check")).start())
    run(query)
    assert spark.table("seen").count() == 10


def expected(spark, events, rules, profiles):
    batch = event_frame(spark, events)
    want = [(r.rule_id, r.event_id, r.message) for r in threshold.threshold_anomalies(batch, rules).collect()]
    return sorted(want + [(r.rule_id, r.event_id, r.message) for r in zscore.zscore_anomalies(batch, profiles).collect()])


def stored_anomalies(spark, layout):
    return sorted((r.rule_id, r.event_id, r.message) for r in layout.anomalies.read(spark).collect())


def test_order_of_files_does_not_matter_within_the_settling_time(spark, tmp_path, events):
    log, layout = str(tmp_path / "log"), Layout(str(tmp_path / "out"))
    rules, profiles = rule_frame(spark, RULES), profile_frame(spark, PROFILES)
    make = lambda: Pipeline(spark, layout, load_rules=lambda: rules, profiles=profiles, settle_seconds=7200)
    for place, k in enumerate((1, 0, 3, 2)):
        write_log(log, events[k * 60:(k + 1) * 60], f"{k}")
        at = time.time() - 1000 + 10 * place
        os.utime(f"{log}/{k}.json", (at, at))
    pipe = make()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = len(fs.listStatus(folder))
    run(pipe.start(log, str(tmp_path / "check"), files_per_batch=1))
    assert len(fs.listStatus(folder)) <= before + 1  # the rules in use
    undecided = stored_anomalies(spark, layout)
    make().finish()
    assert stored_anomalies(spark, layout) == expected(spark, events, rules, profiles) != undecided
    pipe = make()
    pipe.finish()
    assert len(stored_anomalies(spark, layout)) == len(expected(spark, events, rules, profiles))


def test_start_skips_what_was_written_before_and_needs_its_checkpoint(spark, tmp_path, events):
    log, layout = str(tmp_path / "log"), Layout(str(tmp_path / "out"))
    write_log(log, events[:100], "old")
    old = time.time() - 3600
    os.utime(f"{log}/old.json", (old, old))
    write_log(log, events[90:150], "new")
    make = lambda: Pipeline(spark, layout, load_rules=lambda: rule_frame(spark, []), profiles=profile_frame(spark, []))
    start = datetime.fromtimestamp(time.time() - 600, timezone.utc)
    run(make().start(log, str(tmp_path / "check"), start_at=start))
    assert {r.event_id for r in layout.events.read(spark).collect()} == {e["event_id"] for e in events[90:150]}
    with pytest.raises(ValueError):
        make().start(log, str(tmp_path / "check2"))


def test_copies_are_refused_by_the_state_of_the_stream(spark, tmp_path, events):
    log, layout = str(tmp_path / "log"), Layout(str(tmp_path / "out"))
    make = lambda: Pipeline(spark, layout, load_rules=lambda: rule_frame(spark, []), profiles=profile_frame(spark, []))
    at, rows = time.time() - 7200, []
    for k in range(6):  # a file each twenty minutes; ids are held for thirty
        copies = [dict(e, seq=1_000_000 * k + e["seq"], event_type=f"copy{k}") for e in events[max(0, k - 1) * 40:k * 40]]
        write_log(log, events[k * 40:(k + 1) * 40] + copies, f"{k}")
        os.utime(f"{log}/{k}.json", (at + 1200 * k, at + 1200 * k))
        query = make().start(log, str(tmp_path / "check"), files_per_batch=1, id_delay="30 minutes")
        query.processAllAvailable()
        rows.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
        run(query)
    stored = layout.events.read(spark)
    assert stored.count() == len(events) and stored.filter(F.col("event_type").startswith("copy")).isEmpty()
    assert max(rows) <= 160


def test_a_batch_cut_short_is_completed_without_reading_other_batches(spark, tmp_path, events):
    layout = Layout(str(tmp_path / "out"))
    layout.create(spark)
    rows = event_frame(spark, events)
    layout.events.append_new(rows.filter("seq < 90"), 4, unseen=True)
    layout.events.append_new(rows, 4, unseen=True)
    assert layout.events.read(spark).count() == len(events)
    seen = rows.agg(F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).first()
    plan = layout.events._stored_keys(rows, ["event_id"], seen, 4)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(event_date#\d+\), \(event_date#\d+ >= 2024-01-01\)", plan)
    assert re.search(r"batch_id#\d+L = 4", plan)


def test_copies_are_evaluated_where_asked(spark, tmp_path, events):
    layout = Layout(str(tmp_path / "out"))
    copies = [dict(e, seq=10_000 + e["seq"]) for e in events[:200:2]]
    rules = rule_frame(spark, RULES)
    pipe = Pipeline(spark, layout, load_rules=lambda: rules, profiles=profile_frame(spark, PROFILES),
                    settle_seconds=7200, evaluate_copies=True)
    for k, part in enumerate((events[:120], events[120:] + copies[:50], copies[50:])):
        write_log(str(tmp_path / f"log{k}"), part, "a")
        pipe.handle(spark.read.schema(read_log(spark, str(tmp_path / "log0")).schema).json(str(tmp_path / f"log{k}")), k)
    pipe.finish()
    every = [dict(e, event_id=f"{e['event_id']}|{e['seq']}") for e in events + copies]
    want = sorted((r, i.split("|")[0], m) for r, i, m in expected(spark, every, rules, profile_frame(spark, PROFILES)))
    assert stored_anomalies(spark, layout) == want
    assert layout.events.read(spark).count() == len(events)


def test_an_event_dated_ahead_holds_nothing_back(spark, tmp_path, events):
    layout = Layout(str(tmp_path / "out"))
    rules = rule_frame(spark, [("each", "each", True, "info", 30, 30, None, None, ">=", 1)])
    profiles = profile_frame(spark, PROFILES).limit(0)
    ahead = dict(events[0], event_id="ahead", ts_ms=4_070_908_800_000, seq=-1)
    pipe = Pipeline(spark, layout, load_rules=lambda: rules, profiles=profiles, late_seconds=60)
    parts = [[ahead, *events[:80]], events[80:160], events[160:]]
    for k, part in enumerate(parts):
        write_log(str(tmp_path / f"log{k}"), part, "a")
        pipe.handle(spark.read.schema(read_log(spark, str(tmp_path / "log0")).schema).json(str(tmp_path / f"log{k}")), k)
    assert stored_anomalies(spark, layout) == expected(spark, [ahead, *events], rules, profiles)
    assert layout.late.read(spark).count() == len(events) - 80


def test_a_failed_detector_takes_its_batch_up_again(spark, tmp_path, events):
    layout = Layout(str(tmp_path / "out"))
    rules, profiles = rule_frame(spark, RULES), profile_frame(spark, PROFILES)
    pipe = Pipeline(spark, layout, load_rules=lambda: rules, profiles=profiles)
    real, failures = zscore.zscore_fires, [True]

    def once(*args, **kwargs):
        if failures:
            failures.pop()
            raise RuntimeError("once")
        return real(*args, **kwargs)

    zscore.zscore_fires = once
    try:
        for k in range(3):
            write_log(str(tmp_path / f"log{k}"), events[k * 80:(k + 1) * 80], "a")
            pipe.handle(spark.read.schema(read_log(spark, str(tmp_path / "log0")).schema).json(str(tmp_path / f"log{k}")), k)
    finally:
        zscore.zscore_fires = real
    assert not failures and stored_anomalies(spark, layout) == expected(spark, events, rules, profiles)


def test_default_profile_and_entries_without_number(spark, tmp_path):
    base = 1_706_700_000_000
    counts = [2, 4, 2, 4, 3, 20]
    events = [{"event_id": f"{b}-{i}", "event_type": "t", "source": "s", "ts_ms": base + b * 10_000 + i, "seq": b * 100 + i}
              for b, n in enumerate(counts) for i in range(n)]
    write_log(str(tmp_path / "log"), [*events, {"event_id": "x", "event_type": "t", "source": "s", "ts_ms": base, "seq": None}], "a")
    layout = Layout(str(tmp_path / "out"))
    pipe = Pipeline(spark, layout, load_rules=lambda: rule_frame(spark, RULES).limit(0))
    pipe.handle(spark.read.schema(read_log(spark, str(tmp_path / "log")).schema).json(str(tmp_path / "log")), 0)
    assert {r.rule_id for r in layout.anomalies.read(spark).collect()} == {"zscore-count-spike"}
    assert [r.event_id for r in layout.parked.read(spark).collect()] == ["x"]


def test_a_micro_batch_writes_one_file_per_day(spark, tmp_path, events):
    spread = [e | {"ts_ms": e["ts_ms"] + i % 6 * 86_400_000} for i, e in enumerate(events)]
    log, layout = str(tmp_path / "log"), Layout(str(tmp_path / "out"))
    write_log(log, spread, "a")
    pipe = Pipeline(spark, layout, load_rules=lambda: rule_frame(spark, RULES[:1]).limit(0), profiles=profile_frame(spark, PROFILES).limit(0))
    run(pipe.start(log, str(tmp_path / "check")))
    assert layout.events.read(spark).count() == len(spread)
    days = [d for d in (tmp_path / "out" / "events").iterdir() if d.is_dir()]
    assert sorted(len(list(d.glob("*.parquet"))) for d in days) == [1] * 6

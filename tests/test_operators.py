import json
import os
import random
import re
import struct
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from sentrymill.functions.text import anomaly_id, number_text, rate4, round4
from sentrymill.operators import ingest, joins, listing, metrics, outbox, retention, rules, validate
from sentrymill.sources import codec, tables

from .fixtures import T0, at, event_frame, make_events, numbered

UUID = "3f2504e0-4f89-41d3-9a0c-0305e82c3301"


def issues(spark, check, *bodies):
    df = spark.createDataFrame([(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)],
                               "seq bigint, body string")
    return {r.seq: r for r in check(df).collect()}


def event(**changes):
    body = {"event_id": UUID, "event_type": "view", "source": "web", "timestamp": "2026-02-18T12:00:00Z"}
    body |= changes
    return {k: v for k, v in body.items() if v is not ...}


def test_event_validation(spark):
    cases = [
        (event(), []),
        (event(event_id=..., payload={"a": {"b": [1]}}, metadata={}), []),
        (event(event_id="x"), ["event_id: invalid_uuid"]),
        (event(event_id=5), ["event_id: invalid_type"]),
        (event(event_type=""), ["event_type: too_small"]),
        (event(event_type="a" * 256), ["event_type: too_big"]),
        (event(event_type="\U0001F600" * 128), ["event_type: too_big"]),
        (event(event_type="\U0001F600" * 127), []),
        (event(source=...), ["source: required"]),
        (event(source=None), ["source: invalid_type"]),
        (event(timestamp="2026-02-18T12:00:00.123456Z"), []),
        (event(timestamp="2026-02-18T12:00:00+02:00"), ["timestamp: invalid_datetime"]),
        (event(timestamp="2026-02-30T12:00:00Z"), ["timestamp: invalid_datetime"]),
        (event(timestamp="2024-02-29T23:59:59Z"), []),
        (event(timestamp="2026-02-18"), ["timestamp: invalid_datetime"]),
        (event(payload=[1], metadata="x"), ["payload: invalid_type", "metadata: invalid_type"]),
        (event(payload=None), ["payload: invalid_type"]),
        ([1], ["body: invalid_type"]),
        ("{broken", ["body: invalid_type"]),
    ]
    got = issues(spark, validate.validate_events, *[c[0] for c in cases])
    for i, (_, want) in enumerate(cases):
        assert got[i].issues == want, cases[i]
    assert got[0].payload == "{}" and json.loads(got[1].payload) == {"a": {"b": [1]}}


def rule(**changes):
    body = {"name": "n", "enabled": True, "severity": "warning", "window_seconds": 60, "cooldown_seconds": 0,
            "condition": {"type": "threshold", "metric": "count", "filters": {}, "operator": ">", "value": 3}}
    body |= changes
    return {k: v for k, v in body.items() if v is not ...}


def condition(**changes):
    body = rule()["condition"] | changes
    return {k: v for k, v in body.items() if v is not ...}


def test_rule_validation(spark):
    cases = [
        (rule(), []),
        (rule(enabled=..., cooldown_seconds=...), []),
        (rule(name="", severity="high"), ["name: too_small", "severity: invalid_enum"]),
        (rule(window_seconds=0, cooldown_seconds=-1), ["window_seconds: too_small", "cooldown_seconds: too_small"]),
        (rule(window_seconds=60.5), ["window_seconds: not_integer"]),
        (rule(window_seconds="60"), ["window_seconds: invalid_type"]),
        (rule(condition=...), ["condition: required"]),
        (rule(condition=[]), ["condition: invalid_type"]),
        (rule(condition=condition(operator="=>", metric="sum")),
         ["condition.metric: invalid_enum", "condition.operator: invalid_enum"]),
        (rule(condition=condition(filters=..., value=2.5)), []),
        (rule(condition=condition(filters={"event_type": ""})), ["condition.filters.event_type: too_small"]),
        (rule(condition=condition(value="3")), ["condition.value: invalid_type"]),
        ('{"name":"n","severity":"info","window_seconds":1,"condition":{"type":"threshold","metric":"count",'
         '"operator":">","value":1e999}}', ["condition.value: not_finite"]),
    ]
    got = issues(spark, validate.validate_rules_create, *[c[0] for c in cases])
    for i, (_, want) in enumerate(cases):
        assert got[i].issues == want, cases[i]
    assert (got[1].enabled, got[1].cooldown_seconds, got[1].condition.value) == (True, 0, 3.0)
    strict = issues(spark, validate.validate_rules_replace, rule(enabled=..., cooldown_seconds=...))
    assert strict[0].issues == ["enabled: required", "cooldown_seconds: required"]
    patch = issues(spark, validate.validate_rules_patch, {}, {"other": 1}, {"enabled": False}, {"window_seconds": 0})
    assert [patch[i].issues for i in range(4)] == [
        ["body: no_fields"], ["body: no_fields"], [], ["window_seconds: too_small"]]
    assert patch[2].enabled is False and patch[2].name is None


def test_profile_validation(spark):
    inf = float("inf")
    rows = [("a", 60.0, 5.0, 3.0, None), ("", 60.0, 5.0, 3.0, 0.0), ("c", 0.0, 1.0, inf, -1.0), ("d", 1.0, 2.5, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "id string, bucket_seconds double, baseline_buckets double, z_threshold double, cooldown_seconds double")
    got = [r.issues for r in validate.validate_profiles(df).orderBy("id").collect()]
    assert got == [
        ["id: required"], [],
        ["bucket_seconds: invalid", "baseline_buckets: invalid", "z_threshold: invalid", "cooldown_seconds: invalid"],
        ["baseline_buckets: invalid"],
    ]


def test_batches_are_all_or_nothing(spark, monkeypatch):
    monkeypatch.setattr(joins, "SEQ_RUN", 4)
    bodies = [(i, "big", json.dumps(event(event_id=..., source=f"s{i}"))) for i in range(30)]
    bodies += [(100, "bad", json.dumps(event())), (101, "bad", json.dumps(event(source="")))]
    df = spark.createDataFrame(bodies, "seq bigint, batch_id string, body string").repartition(3)
    gated = ingest.batch_gate(ingest.assign_event_id(validate.validate_events(df)))
    receipt = ingest.batch_receipt(gated).collect()
    ok = sorted((r for r in receipt if r.batch_id == "big"), key=lambda r: r.position)
    assert [r.position for r in ok] == list(range(30))
    assert {(r.status, r["count"]) for r in ok} == {("accepted", 30)}
    by_seq = {r.seq: r.event_id for r in gated.collect()}
    assert [r.event_id for r in ok] == [by_seq[i] for i in range(30)]
    assert len(set(by_seq.values())) == 31  # the two bad ones were sent with one id
    bad, = (r for r in receipt if r.batch_id == "bad")
    assert (bad.status, bad["count"], bad.issue) == ("rejected", 2, "source: too_small")


def test_first_copy_wins_and_stored_ids_are_refused(spark):
    events = numbered([at(i, payload=str(i)) for i in range(4)])
    for e, name in zip(events, ["x", "y", "x", "z"]):
        e["event_id"] = name
    ev = event_frame(spark, events)
    assert sorted((r.event_id, r.payload) for r in ingest.dedup_events(ev).collect()) == [("x", "0"), ("y", "1"), ("z", "3")]
    stored = ev.filter("event_id = 'y'")
    assert sorted(r.event_id for r in ingest.new_events(ev, stored).collect()) == ["x", "z"]


def test_codec_round_trip_and_defaults(spark):
    ev = event_frame(spark, numbered([at(0, payload='{"a":1}'), at(1.5)]))
    back = codec.decode_events(codec.as_entries(codec.encode_events(ev))).orderBy("seq").collect()
    assert [r.timestamp for r in back] == ["2024-01-01T00:00:00.000Z", "2024-01-01T00:00:01.500Z"]
    assert back[0].payload == '{"a":1}' and not back[0].malformed
    odd = spark.createDataFrame([(1, {"payload": "{"}), (2, {})], "seq bigint, fields map<string,string>")
    bad, empty = codec.decode_events(odd).orderBy("seq").collect()
    assert bad.malformed and not empty.malformed
    assert (empty.event_id, empty.timestamp, empty.metadata) == ("", "", "{}")


@pytest.mark.parametrize("given,want", [
    ((None, None), (50, 0)), ((0, None), (1, 0)), ((9999, -10), (500, 0)), ((-5, 7), (1, 7)), ((200, 3), (200, 3)),
])
def test_page_arguments(given, want):
    assert listing.page_args(*given) == want


def test_bad_arguments():
    with pytest.raises(ValueError):
        listing.page_args(1.5)
    with pytest.raises(ValueError):
        listing.check_range(T0 + timedelta(1), T0)
    with pytest.raises(ValueError):
        metrics.resolve_group("user")
    for w in (9, 3601, 10.5, float("nan")):
        with pytest.raises(ValueError):
            metrics.resolve_window(w)
    assert [metrics.resolve_window(w, clamp=True) for w in (None, 1, 9999, 120)] == [60, 10, 3600, 120]


def test_lists(spark):
    ev = event_frame(spark, numbered([at(i, event_type="a" if i % 2 else "b") for i in range(10)]))
    ev = ev.withColumn("created_at", F.col("timestamp"))
    ids = lambda df: [r.event_id for r in df.collect()]
    assert ids(listing.list_events(ev, 3)) == ["e9", "e8", "e7"]
    assert ids(listing.list_events(ev, 2, 1, event_type="a")) == ["e7", "e5"]
    assert ids(listing.list_events(ev, start=T0 + timedelta(seconds=3), end=T0 + timedelta(seconds=5))) == ["e5", "e4", "e3"]
    assert ids(listing.list_events(ev, 2, after=(T0 + timedelta(seconds=8), "e8"))) == ["e7", "e6"]
    assert ids(listing.get_event(ev, "e4")) == ["e4"] and ids(listing.get_event(ev, "no")) == []
    assert listing.page_info(listing.list_events(ev, 4, 8), 4, 8).collect() == [(4, 8, 2)]
    assert len(ids(listing.live_feed(ev, "15m", T0 + timedelta(seconds=902)))) == 8
    anomalies = spark.createDataFrame(
        [("a1", "e1", "r", "low", "m", T0), ("a2", "gone", "r", "high", "m", T0 + timedelta(1))],
        "anomaly_id string, event_id string, rule_id string, severity string, message string, detected_at timestamp")
    assert [r.anomaly_id for r in listing.anomaly_timeline(anomalies).collect()] == ["a2", "a1"]
    assert [r.anomaly_id for r in listing.list_anomalies(anomalies, severity="low").collect()] == ["a1"]
    seen = {r.anomaly_id: r.event_type for r in listing.anomaly_drilldown(anomalies, ev).collect()}
    assert seen == {"a1": "a", "a2": None}


def test_metrics(spark):
    edge = [at(0), at(60), at(-1), at(60.001), at(30, event_type="Failed_login")]
    ev = event_frame(spark, numbered(edge))
    m = metrics.window_metrics(ev, T0 + timedelta(seconds=60), 60)
    assert {(r.key, r["count"], r.rate_per_sec) for r in m.collect()} == {("error", 2, 0.0333), ("Failed_login", 1, 0.0167)}
    gauge = metrics.error_rate(m).first()
    assert (gauge.error_count, gauge.total_count, gauge.error_pct, gauge.status) == (3, 3, 100.0, "Critical")
    assert [r.key for r in metrics.top_events(m).collect()] == ["error", "Failed_login"]
    assert metrics.error_rate(m.filter("false")).count() == 0
    buckets = metrics.bucket_counts(ev, 60).collect()
    assert sorted(r["count"] for r in buckets) == [1, 2, 2]
    pct = spark.createDataFrame([(0.99,), (1.0,), (4.99,), (5.0,)], "p double")
    assert [r[0] for r in pct.select(metrics.health_class(F.col("p"))).collect()] == ["Healthy", "Warning", "Warning", "Critical"]


def test_number_texts(spark):
    values = [2.0, 0.5, 0.0005, -3.0, 1e21, 1.5e-7, 123456789.25, 0.0, 1e6, 2.2361]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(number_text(F.col("x"))).collect()] == [
        "2", "0.5", "0.0005", "-3", "1e+21", "1.5e-7", "123456789.25", "0", "1000000", "2.2361"]
    rng = random.Random(3)
    anything = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)] + [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 24) for _ in range(3000)]
    anything += [2.0 ** -44, 1e20, 1e19, 1.2345678901234567e-6, 0.0012345678901234567, 5e-324, 1.7976931348623157e308, 2e-3, 9007199254740993.0]
    anything = [v for v in anything if v == v and abs(v) != float("inf")]
    df = spark.createDataFrame([(v,) for v in anything], "x double").coalesce(4)
    for v, (text,) in zip(anything, df.select(number_text(F.col("x"))).collect()):
        digits = lambda t: re.sub("0+$", "", re.sub("^[-0.]+", "", t.partition("e")[0]).replace(".", ""))
        assert float(text) == v and len(digits(text)) == len(digits(repr(v))), (v, text)
        assert ("e" in text) == (v != 0 and (abs(v) >= 1e21 or abs(v) < 1e-6)) and not text.endswith(".")
    counts = spark.createDataFrame([(120,), (30,), (7,)], "n bigint")
    assert [r[0] for r in counts.select(rate4(F.col("n"), 60)).collect()] == [2.0, 0.5, 0.1167]
    assert spark.range(1).select(round4(F.lit(0.894427))).first()[0] == 0.8944
    ids = spark.range(1).select(anomaly_id(F.lit("r"), F.lit("e")), anomaly_id(F.lit("r"), F.lit("e"))).first()
    assert ids[0] == ids[1] and len(ids[0]) == 36


def fold(changes):
    """One change at a time."""
    live = {}
    for c in sorted(changes, key=lambda c: c["seq"]):
        rid, why = c["rule_id"], c["reason"]
        given = {f: c[f] for f in rules.FIELDS if c[f] is not None}
        if why == "create" and rid not in live:
            live[rid] = given | {"created_at": c["at"], "updated_at": c["at"]}
        elif why in ("update", "patch") and rid in live:
            live[rid] |= given | {"updated_at": c["at"]}
        elif why == "delete":
            live.pop(rid, None)
    return live


@pytest.mark.parametrize("seed", range(2))
def test_rule_changes_equal_one_by_one(spark, seed, monkeypatch):
    monkeypatch.setattr(joins, "SEQ_RUN", 32)
    rnd = random.Random(seed)
    changes = []
    for i in range(400):
        why = rnd.choices(["create", "update", "patch", "delete"], [3, 2, 5, 1])[0]
        some = lambda v: v if why in ("create", "update") or rnd.random() < 0.4 else None
        changes.append({
            "rule_id": "hot" if rnd.random() < 0.4 else f"r{rnd.randrange(25)}", "seq": i,
            "at": T0 + timedelta(seconds=i), "reason": why, "name": some(f"n{i}"), "enabled": some(rnd.random() < 0.5),
            "severity": some("info"), "window_seconds": some(i), "cooldown_seconds": some(i % 7),
            "condition": some(("threshold", "count", (None, f"s{i}"), ">", float(i))),
        })
    schema = ("rule_id string, seq bigint, at timestamp, reason string, name string, enabled boolean, severity string, "
              "window_seconds int, cooldown_seconds int, condition struct<type string, metric string, "
              "filters struct<event_type string, source string>, operator string, value double>")
    df = spark.createDataFrame([tuple(c.values()) for c in changes], schema).repartition(4)
    got = {r.rule_id: r.asDict(recursive=False) for r in rules.apply_rule_changes(df).collect()}
    want = fold(changes)
    assert set(got) == set(want) and len(want) > 5
    for rid, row in want.items():
        for f in ("name", "enabled", "severity", "window_seconds", "cooldown_seconds"):
            assert got[rid][f] == row[f], (rid, f)
        assert got[rid]["condition"].value == row["condition"][4]
        stamp = lambda t: t.astimezone(T0.tzinfo)
        assert stamp(got[rid]["created_at"]) == row["created_at"] and stamp(got[rid]["updated_at"]) == row["updated_at"]


def test_requests_become_rules(spark, tmp_path):
    def requests(check, first_seq, *bodies, rule_id=None):
        rows = [(first_seq + i, T0 + timedelta(seconds=first_seq + i), rule_id, json.dumps(b)) for i, b in enumerate(bodies)]
        return check(spark.createDataFrame(rows, "seq bigint, at timestamp, rule_id string, body string"))

    created = rules.as_changes(
        requests(validate.validate_rules_create, 0, rule(name="a", enabled=...), rule(name="b"), rule(name="")), "create")
    ids = {r.name: r.rule_id for r in created.collect()}
    assert set(ids) == {"a", "b"}
    patched = rules.as_changes(requests(validate.validate_rules_patch, 10, {"enabled": False}, {}, rule_id=ids["a"]), "patch")
    replaced = rules.as_changes(
        requests(validate.validate_rules_replace, 20, rule(name="b2", severity="info"), rule_id=ids["b"]), "update")
    absent = rules.as_changes(requests(validate.validate_rules_patch, 30, {"name": "x"}, rule_id="none"), "patch")
    log = created.unionByName(patched).unionByName(replaced).unionByName(absent)
    path = str(tmp_path / "rules")
    with pytest.raises(FileNotFoundError):
        rules.read_rules(spark, path)
    rules.write_rules(rules.apply_rule_changes(log), path)
    now = rules.read_rules(spark, path)
    now.withColumn("version", F.lit(1)).write.mode("append").partitionBy("version").parquet(path)  # a write that was cut short
    now = rules.read_rules(spark, path)
    assert sorted((r.name, r.enabled, r.severity) for r in now.collect()) == [("a", False, "warning"), ("b2", True, "info")]
    assert [r.name for r in rules.enabled_rules(now).collect()] == ["b2"]
    assert rules.get_rule(now, ids["a"]).count() == 1
    gone = spark.createDataFrame([(40, T0, ids["a"])], "seq bigint, at timestamp, rule_id string")
    rules.write_rules(rules.apply_rule_changes(log.unionByName(rules.as_changes(gone, "delete"))), path)
    assert [r.name for r in rules.read_rules(spark, path).collect()] == ["b2"]
    message = json.loads(rules.change_messages(replaced).first()[0])
    assert message == {"ts": "2024-01-01T00:00:20.000Z", "reason": "update", "rule_id": ids["b"]}


def test_outbox(spark):
    anomalies = spark.createDataFrame(
        [("a1", "e1", "r1", "warning", 'say "hi"', T0)],
        "anomaly_id string, event_id string, rule_id string, severity string, message string, detected_at timestamp")
    rows = {r.channel: r for r in outbox.notification_outbox(anomalies).collect()}
    assert {c: r.status for c, r in rows.items()} == {
        "websocket": "pending", "slack": "skipped_disabled", "email": "skipped_disabled"}
    assert json.loads(rows["websocket"].body) == {
        "type": "anomaly", "severity": "warning", "message": 'say "hi"', "detected_at": "2024-01-01T00:00:00.000Z",
        "anomaly_id": "a1", "rule_id": "r1"}
    on = {"websocket": {"enabled": False}, "slack": {"enabled": True, "webhook_url": "http://x"}, "email": {"enabled": "yes"}}
    rows = {r.channel: r for r in outbox.notification_outbox(anomalies, on).collect()}
    assert {c: r.status for c, r in rows.items()} == {
        "websocket": "skipped_disabled", "slack": "pending", "email": "skipped_disabled"}
    assert json.loads(rows["slack"].body)["text"] == (
        '*[WARNING]* Anomaly detected\n>say "hi"\nRule: `r1` | Detected: 2024-01-01T00:00:00.000Z')
    sent = outbox.notification_message(anomalies).unionByName(
        spark.createDataFrame([("nope",), ('{"anomaly_id":"a"}',), ('{"anomaly_id":"","rule_id":"r","severity":"s"}',)], "message string"))
    assert outbox.outbox_from_messages(sent).count() == 3


def test_retention(spark, tmp_path):
    events = numbered([at(86400 * d + 3600 * h) for d in range(6) for h in (1, 13)])
    ev = event_frame(spark, events)
    as_of = T0 + timedelta(days=6)
    assert retention.retain_events(ev, as_of, 0).count() == 12
    assert retention.retain_events(ev, as_of, 3).count() == 6
    path = str(tmp_path / "events")
    tables.write_events(ev, path)
    removed = retention.drop_expired_days(spark, path, as_of - timedelta(hours=18), 3)
    assert removed == ["2024-01-01", "2024-01-02"]
    kept = tables.read_events(spark, path)
    assert kept.count() == 7
    # again does no harm, also after the day of the cut was overwritten
    assert retention.drop_expired_days(spark, path, as_of - timedelta(hours=18), 3) == []
    assert tables.read_events(spark, path).count() == 7
    day3 = tables.read_events(spark, path, T0 + timedelta(days=2), T0 + timedelta(days=3, hours=2))
    assert sorted(r.event_id for r in day3.collect()) == ["e5", "e6"]

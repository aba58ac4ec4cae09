import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrymill.operators import cooldown, joins, ranking, threshold, zscore
from sentrymill.operators.builtin import invalid_payload, rate_spike, timestamp_drift
from sentrymill.operators.joins import match_filters, prepare_control

from . import simulate
from .fixtures import at, day, event_frame, make_events, numbered, profile_frame, rule_frame

RULES = [
    ("any", "any", True, "warning", 60, 0, None, None, ">", 4),
    ("any-cd", "any cd", True, "critical", 300, 600, None, None, ">=", 10),
    ("err", "err", True, "info", 30, 45, "error", None, "!=", 2),
    ("hot", "hot", True, "info", 900, 7, None, "hot", ">", 3),
    ("both", "both", True, "info", 3600, 1, "view", "s1", "<=", 5),
    ("eq", "eq", True, "info", 10, 3, "click", None, "==", 1),
    ("lt", "lt", True, "info", 10, 0, "click", "s2", "<", 2),
    ("off", "off", False, "info", 10, 0, None, None, ">", 0),
]
PROFILES = [
    ("a", 60, 5, 1.5, 0, None, None),
    ("b", 120, 3, 1.0, 300, "error", None),
    ("c", 30, 4, 2.0, 10, None, "hot"),
]


@pytest.mark.parametrize("group_rows", [10**6, 0], ids=["one-shuffle", "bounded"])
def test_threshold_equals_event_by_event(spark, group_rows, monkeypatch):
    monkeypatch.setattr(ranking, "SLICE_MS", 7_000)
    monkeypatch.setattr(joins, "SEQ_RUN", 5)
    events = make_events()
    counts, fires = simulate.threshold(events, RULES)
    ev, rules = event_frame(spark, events), rule_frame(spark, RULES)
    got = threshold.sliding_rule_counts(ev, rules, group_rows).collect()
    assert {(r.rule_id, r.event_id): r["count"] for r in got} == counts
    assert len(got) == len(counts)
    found = threshold.threshold_anomalies(ev, rules, group_rows).collect()
    assert sorted((r.rule_id, r.event_id) for r in found) == [f[:2] for f in fires]
    by_key = {(r.rule_id, r.event_id): r.message for r in found}
    for rid, eid, n in fires:
        assert f"count({n})" in by_key[rid, eid]


@pytest.mark.parametrize("group_rows", [10**6, 0], ids=["one-shuffle", "bounded"])
def test_zscore_equals_event_by_event(spark, group_rows, monkeypatch):
    monkeypatch.setattr(zscore, "BLOCK_BUCKETS", 8)
    monkeypatch.setattr(joins, "SEQ_RUN", 5)
    events = make_events(seed=3)
    ev, profiles = event_frame(spark, events), profile_frame(spark, PROFILES)
    cands = zscore.zscore_candidates(ev, profiles, group_rows)
    got = zscore.zscore_fires(cands, profiles).collect()
    want = simulate.zscore(events, PROFILES)
    assert len(want) > 5
    assert sorted((r.rule_id, r.event_id, r.details.current_count) for r in got) == want


@pytest.mark.parametrize("group_rows", [10**6, 0], ids=["one-shuffle", "bounded"])
def test_rate_spike_equals_event_by_event(spark, group_rows):
    events = make_events(seed=5)
    got = rate_spike(event_frame(spark, events), 6, 60, group_rows).collect()
    want = simulate.rate(events, 60, 6)
    assert len(want) > 20
    assert sorted((r.event_id, int(r.message.split()[2])) for r in got) == want


@pytest.mark.parametrize("seed", range(2))
def test_parallel_cooldown_equals_greedy(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    waits = {"dense": 50, "sparse": 400, "one": 1, "long": 5_000}
    rows, want = [], []
    for key, wait in waits.items():
        step = 3 if key != "sparse" else 900
        t, times = 1_000_000, []
        for _ in range(1500):
            t += rnd.choice([0, 1, step, 2 * step, 40 * step if rnd.random() < 0.02 else 1])
            times.append(t)
        rows += [(key, wait, t, i, f"{key}{i}") for i, t in enumerate(times)]
        want += [(key, t) for t in simulate.greedy(times, wait)]
    df = spark.createDataFrame(rows, "rule_id string, cooldown_ms bigint, ts_ms bigint, seq bigint, event_id string")
    for direct_rows, fan_in in [(10**6, 16), (100, 2), (1, 3)]:
        got = cooldown.apply_cooldown(df, "rule_id", ["event_id"], direct_rows=direct_rows, fan_in=fan_in).collect()
        assert sorted((r.rule_id, r.ts_ms) for r in got) == sorted(want), (direct_rows, fan_in)


def test_cooldown_heeds_earlier_fires(spark):
    df = spark.createDataFrame(
        [("r", 100, t, t, str(t)) for t in range(0, 1000, 30)],
        "rule_id string, cooldown_ms bigint, ts_ms bigint, seq bigint, event_id string")
    earlier = spark.createDataFrame([("r", 55), ("r", 615), ("r", 5000), ("other", 300)], "rule_id string, fire_ms bigint")
    got = cooldown.apply_cooldown(df, "rule_id", ["event_id"], earlier=earlier)
    want, last, known = [], -1000, [55, 615, 5000]
    for t in range(0, 1000, 30):  # earlier fires restart the wait when their time comes
        last = max([last] + [f for f in known if f <= t])
        if t - last >= 100:
            want.append(t)
            last = t
    assert sorted(r.ts_ms for r in got.collect()) == want


def test_walk_equals_one_step_at_a_time():
    rng = np.random.default_rng(5)
    for _ in range(200):
        times = np.unique(rng.integers(0, 500, rng.integers(0, 80)))
        wait, start, want = int(rng.integers(1, 60)), int(rng.integers(-5, 520)), []
        for t in times:
            if t >= start and (not want or t - want[-1] >= wait):
                want.append(t)
        assert cooldown.walk(times, wait, start).tolist() == want


def test_walk_fires_at_equality():
    assert list(cooldown.walk(np.array([0, 99, 100, 199, 200]), 100)) == [0, 100, 200]


def test_large_control_table_is_not_broadcast(spark):
    ev = event_frame(spark, make_events(n=120)).withColumn("ts_ms", F.unix_millis("timestamp"))
    control = spark.createDataFrame(
        [("r1", None, None), ("r2", "error", None), ("r3", None, "hot"), ("r4", "view", "hot")],
        "rule_id string, f_type string, f_source string")
    control = prepare_control(control)
    small = match_filters(ev, control, ["rule_id"]).select("rule_id", "event_id")
    large = match_filters(ev, control, ["rule_id"], max_broadcast=0).select("rule_id", "event_id")
    assert sorted(small.collect()) == sorted(large.collect())
    assert small.count() > 120


def test_threshold_golden(spark):
    """Each case has a source and a rule of its own, so one run covers them all."""
    cases = []  # events, (window, cooldown, operator, value, enabled), events that fire
    for op, quiet, loud in [(">", 3, 4), (">=", 2, 3), ("<", 3, 2), ("<=", 4, 3), ("==", 4, 3), ("!=", 3, 2)]:
        holds = simulate.HOLDS[op]
        for n in (quiet, loud):
            cases.append(([0] * n, (60, 0, op, 3, True), [i for i in range(n) if holds(i + 1, 3)]))
            assert (n - 1 in cases[-1][2]) == (n == loud)
    cases += [
        ([0, 20, 30], (60, 0, ">=", 3, True), [2]),
        ([0, 5, 30], (10, 0, ">", 2, True), []),
        ([0, 10], (10, 0, ">=", 2, True), [1]),
        ([0, 10.001], (10, 0, ">=", 2, True), []),
        ([0, 30, 61], (60, 60, ">=", 1, True), [0, 2]),
        ([0, 60], (60, 60, ">=", 1, True), [0, 1]),
        ([0, 30, 61], (60, 0, ">=", 1, True), [0, 1, 2]),
        ([0], (60, 0, ">=", 1, False), []),
    ]
    events, rules, want = [], [], []
    for c, (times, (window, wait, op, value, on), hits) in enumerate(cases):
        rules.append((f"r{c}", f"rule {c}", on, "warning", window, wait, None, f"case{c}", op, value))
        events += [at(t, source=f"case{c}", event_id=f"{c}-{i}") for i, t in enumerate(times)]
        want += [f"{c}-{i}" for i in hits]
    found = threshold.threshold_anomalies(event_frame(spark, numbered(events)), rule_frame(spark, rules)).collect()
    assert sorted(r.event_id for r in found) == sorted(want)
    first = next(r for r in found if r.event_id == "1-3")
    assert first.message == 'Threshold rule "rule 1" triggered: count(4) > 3' and first.severity == "warning"


def spike(case, counts, gap=0, extra=8, event_type="error"):
    """Minutes with these counts, then ``extra`` events in a later minute."""
    events = [(b * 60 + i * 0.1) for b, n in enumerate(counts) for i in range(n)]
    start = (len(counts) + gap) * 60
    events += [start + i * 0.1 for i in range(extra)]
    return [at(t, source=case, event_type=event_type) for t in events]


def test_zscore_golden(spark):
    """Each case has a source and a profile of its own."""
    varied = [2, 4, 2, 4, 3]
    cases = {
        "spike": spike("spike", varied),
        "uniform": spike("uniform", [5] * 5),
        "short": spike("short", varied[:4]),
        "gap1": spike("gap1", varied, gap=1),
        "gap2": spike("gap2", varied, gap=2),
        "cooldown": spike("cooldown", varied, extra=30),
        "typed": spike("typed", varied),
        "other": spike("other", varied, event_type="view"),
    }
    profiles = [
        (name, 60, 5, 2.0, 120 if name == "cooldown" else 0, "error" if name in ("typed", "other") else None, name)
        for name in cases
    ]
    ev = event_frame(spark, numbered([e for events in cases.values() for e in events]))
    rows = zscore.zscore_anomalies(ev, profile_frame(spark, profiles)).collect()
    got = {name: sorted(r.details.current_count for r in rows if r.rule_id == name) for name in cases}
    assert got == {
        "spike": [5, 6, 7, 8], "uniform": [], "short": [], "gap1": [5, 6, 7, 8], "gap2": [], "cooldown": [5],
        "typed": [5, 6, 7, 8], "other": [],
    }
    first = next(r for r in rows if r.rule_id == "spike" and r.details.current_count == 5)
    assert (first.details.mean, first.details.stddev, first.details.z) == (3.0, 0.8944, 2.2361)
    assert first.severity == "warning"
    assert first.message == (
        "Z-score spike detected (source=spike): z=2.2361, current=5, mean=3, stddev=0.8944, bucketSeconds=60, "
        "bucketStart=2024-01-01T00:05:00.000Z")
    typed = next(r for r in rows if r.rule_id == "typed")
    assert "(event_type=error, source=typed)" in typed.message


def test_rate_spike_limits(spark):
    ev = event_frame(spark, numbered([at(0), at(1), at(2), at(3)]))
    row, = rate_spike(ev, 3, 60).collect()
    assert row.event_id == "e3" and row.severity == "high"
    assert row.message == 'Rate spike: 4 events from source "payment_service" in 60s (threshold: 3)'


def test_invalid_payload_golden(spark):
    cases = [
        ("page_view", "{}"), ("page_view", '{"url":"/"}'), ("button_click", '{"url":"/"}'),
        ("page_view", '{"url":null}'), ("other", "{}"), ("form_submit", "{}"),
    ]
    ev = event_frame(spark, numbered([at(i, event_type=t, payload=p) for i, (t, p) in enumerate(cases)]))
    got = {r.event_id: r.message for r in invalid_payload(ev).collect()}
    assert got == {
        "e0": 'Missing required payload fields for "page_view": url',
        "e2": 'Missing required payload fields for "button_click": element_id',
        "e3": 'Missing required payload fields for "page_view": url',
        "e5": 'Missing required payload fields for "form_submit": url, form_name',
    }


def test_timestamp_drift_golden(spark):
    raws = ["2023-12-31T23:55:00Z", "2023-12-31T23:54:59Z", "2024-01-01T00:10:00Z", "not-a-date"]
    ev = event_frame(spark, numbered([at(i) for i in range(4)])).withColumn(
        "raw", F.element_at(F.array(*[F.lit(r) for r in raws]), F.col("seq").cast("int") + 1))
    got = {r.event_id: r.message for r in timestamp_drift(ev, day(0), raw="raw").collect()}
    assert got == {
        "e1": "Timestamp drift: 301s in the past (threshold: 300s)",
        "e2": "Timestamp drift: 600s in the future (threshold: 300s)",
        "e3": 'Unparseable timestamp: "not-a-date"',
    }


def test_only_fresh_events_become_candidates_and_the_others_count(spark):
    ev = event_frame(spark, make_events(n=300, grain_ms=1000))
    rules = rule_frame(spark, [
        ("any", "any", True, "info", 300, 0, None, None, ">=", 5), ("odd", "odd", True, "info", 300, 0, None, None, "~", 1)])
    profiles = profile_frame(spark, [("a", 60, 5, 0.5, 0, None, None)])
    fresh = F.col("seq") % 2 == 0
    for run, control, columns in (
        (threshold.threshold_candidates, rules, ["rule_id", "event_id", "seq", "count"]),
        (zscore.zscore_candidates, profiles, ["profile_id", "event_id", "seq", "current", "z"]),
    ):
        whole = {tuple(r) for r in run(ev, control).select(columns).collect()}
        assert {tuple(r) for r in run(ev, control, fresh=fresh).select(columns).collect()} == {r for r in whole if r[2] % 2 == 0}
        assert any(r[2] % 2 for r in whole)


def test_wide_baselines_are_walked_for_buckets_that_may_reach_the_threshold():
    rng = np.random.default_rng(5)
    for n, scale in ((70, 4), (200, 3), (300, 100_000)):
        values = rng.poisson(scale, 3000).astype("float64")
        at = np.arange(n, len(values))
        for z in (0.5, 1.0, 2.5):
            mean, stddev = np.array([np.cumsum(values[k - n:k])[-1] / n for k in at]), np.zeros(len(at))
            for i, k in enumerate(at):
                gap = values[k - n:k] - mean[i]
                stddev[i] = np.sqrt(np.cumsum(gap * gap)[-1] / n)
            reaches, kept = (values[at] - mean) / stddev >= z, zscore.may_reach(values, at, n, mean, z)
            assert not (reaches & ~kept).any()
            assert kept.sum() <= reaches.sum() + 2
    flat = np.full(500, 7.0)
    assert zscore.may_reach(flat, np.arange(100, 500), 100, np.full(400, 7.0), 1.0).all()

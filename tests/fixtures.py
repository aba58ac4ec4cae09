"""Small event tables with ties, bursts and gaps."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

from sentrymill.schemas import EVENTS, PROFILES, RULES

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def make_events(n=600, seed=7, span_s=7200, hot=0.34, grain_ms=500):
    """A third of the rows share one source, and many share a millisecond."""
    rnd = random.Random(seed)
    events = []
    for i in range(n):
        at = rnd.randrange(span_s * 1000 // grain_ms) * grain_ms
        if rnd.random() < hot:
            at = 3_000_000 + rnd.randrange(20) * grain_ms
        events.append({
            "event_id": f"e{i}",
            "event_type": rnd.choice(["error", "view", "click"]),
            "source": "hot" if rnd.random() < hot else f"s{rnd.randrange(4)}",
            "ts_ms": 1_704_067_200_000 + at,
        })
    events.sort(key=lambda e: e["ts_ms"])
    for i, e in enumerate(events):
        e["seq"] = i * 3
    return events


def event_frame(spark, events):
    rows = [
        (e["event_id"], e["event_type"], e["source"],
         datetime.fromtimestamp(e["ts_ms"] / 1000, timezone.utc),
         e.get("payload", "{}"), "{}", T0, e["seq"])
        for e in events
    ]
    return spark.createDataFrame(rows, EVENTS).repartition(4)


def at(seconds, **fields):
    """One event ``seconds`` after T0."""
    base = {"event_type": "error", "source": "payment_service", "ts_ms": 1_704_067_200_000 + int(seconds * 1000)}
    return base | fields


def numbered(events):
    return [{"event_id": f"e{i}"} | e | {"seq": i} for i, e in enumerate(events)]


def rule_frame(spark, rules):
    return spark.createDataFrame(
        [(r[0], r[1], r[2], r[3], r[4], r[5], ("threshold", "count", (r[6], r[7]), r[8], float(r[9])), None, None)
         for r in rules], RULES)


def profile_frame(spark, profiles):
    return spark.createDataFrame(
        [(p[0], float(p[1]), float(p[2]), float(p[3]), float(p[4]), (p[5], p[6])) for p in profiles], PROFILES)


def day(n):
    return T0 + timedelta(days=n)

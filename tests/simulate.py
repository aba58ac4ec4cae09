"""Event-by-event statements of the detectors, for comparison on small inputs."""

from __future__ import annotations

import math
from collections import defaultdict

HOLDS = {
    ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v, "==": lambda c, v: c == v, "!=": lambda c, v: c != v,
}


def meets(event, f_type, f_source):
    return (f_type is None or f_type == event["event_type"]) and (f_source is None or f_source == event["source"])


def threshold(events, rules):
    """events: dicts with event_id, event_type, source, ts_ms, seq; rules: RULE_LIST tuples.
    Returns {(rule_id, event_id): count} for all matches, and the fires."""
    counts, fires = {}, []
    seen, last = defaultdict(list), defaultdict(int)
    for e in sorted(events, key=lambda e: (e["ts_ms"], e["seq"])):
        for rid, _, on, _, w, c, ft, fs, op, v in rules:
            if not on or not meets(e, ft, fs):
                continue
            seen[rid].append(e["ts_ms"])
            n = sum(1 for t in seen[rid] if t >= e["ts_ms"] - w * 1000)
            counts[rid, e["event_id"]] = n
            if not HOLDS.get(op, lambda c, v: False)(n, v):
                continue
            if c > 0 and e["ts_ms"] - last[rid] < c * 1000:
                continue
            last[rid] = e["ts_ms"]
            fires.append((rid, e["event_id"], n))
    return counts, sorted(fires)


def zscore(events, profiles):
    fires, last = [], {}
    counts = defaultdict(lambda: defaultdict(int))
    for e in sorted(events, key=lambda e: (e["ts_ms"], e["seq"])):
        for pid, size, n, limit, wait, ft, fs in profiles:
            if not meets(e, ft, fs):
                continue
            b = math.floor(e["ts_ms"] / (size * 1000))
            counts[pid][b] += 1
            past = [counts[pid][x] for x in sorted(counts[pid]) if b - (n + 1) <= x < b][-n:]
            if len(past) < n:
                continue
            total = 0.0
            for x in past:
                total += x
            mean = total / n
            acc = 0.0
            for x in past:
                acc += (x - mean) * (x - mean)
            dev = math.sqrt(acc / n)
            if dev <= 0 or (counts[pid][b] - mean) / dev < limit:
                continue
            if wait > 0 and pid in last and e["ts_ms"] - last[pid] < wait * 1000:
                continue
            last[pid] = e["ts_ms"]
            fires.append((pid, e["event_id"], counts[pid][b]))
    return sorted(fires)


def rate(events, window, most):
    out, seen = [], defaultdict(list)
    for e in sorted(events, key=lambda e: (e["ts_ms"], e["seq"])):
        seen[e["source"]].append(e["ts_ms"])
        n = sum(1 for t in seen[e["source"]] if e["ts_ms"] - window * 1000 <= t)
        if n > most:
            out.append((e["event_id"], n))
    return sorted(out)


def greedy(times, cooldown):
    fired = []
    for t in sorted(times):
        if not fired or t - fired[-1] >= cooldown:
            fired.append(t)
    return fired

"""SQL that DuckDB runs on the same tables, one text per registered query.

Written from the definition of each operator, with other formulations than the
Spark side where there is a choice (range frames, recursive queries, list folds).
"""

from __future__ import annotations

from . import derived as d

ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
EV = f"""ev AS (
  SELECT *, cast(json_extract_string(payload, '$.k') AS integer) AS k, {ISO.format('"timestamp"')} AS iso,
         epoch_us("timestamp") // 1000 AS ts_ms
  FROM (SELECT cast(event_id AS varchar) AS event_id, event_type, 'user-' || cast(user_id AS varchar) AS source,
               ts AS "timestamp", props AS payload, '{{}}' AS metadata, ts AS created_at, event_id AS seq
        FROM events))"""
# Copies of an event as events of their own, told apart by their arrival number.
_EV_COPIES = f"""{EV.replace('ev AS', 'base AS', 1)}, ev AS (
  SELECT * REPLACE (event_id || chr(31) || cast({d.COPY_SEQ} AS varchar) AS event_id, {d.COPY_SEQ} AS seq)
  FROM (SELECT *, unnest({d.COPY_LIST.format('[', ']')}) AS copy FROM base))"""
# Events close to one another.
_EV_DENSE = f"""{EV.replace('ev AS', 'base AS', 1)}, dense AS (
  SELECT * REPLACE (make_timestamp(({d.DENSE_MS}) * 1000) AS "timestamp", {d.DENSE_MS} AS ts_ms) FROM base),
  ev AS (SELECT * REPLACE ({ISO.format('"timestamp"')} AS iso) FROM dense)"""
# Eight equal ranges of arrival numbers.
_PARTS = """parts AS (SELECT *, least(floor((seq - min(seq) OVER ()) * 8 / (max(seq) OVER () - min(seq) OVER () + 1)), 7) AS part FROM ev)"""
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v).lower() if isinstance(v, bool) else repr(v)


def values(rows) -> str:
    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


def iso_ms(ms: str) -> str:
    return ISO.format(f"make_timestamp(cast({ms} AS bigint) * 1000)")


def anomaly_id(rule: str = "rule_id") -> str:
    return d.uuid_of(f"{rule} || '|' || event_id")


EVENT_COLUMNS = f"""event_id, event_type, source, iso AS "timestamp", payload, metadata, iso AS created_at"""


def number(x: str) -> str:
    """Text of a double of everyday size: its shortest digits, no point for whole numbers."""
    return f"regexp_replace(cast(cast({x} AS double) AS varchar), '\\.0$', '')"


# ---- validation ----------------------------------------------------------

_OBJ = "json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body ELSE 'null' END) = 'OBJECT'"
_NUM = "('BIGINT', 'UBIGINT', 'DOUBLE')"


def _kind(path: str) -> str:
    return f"json_type(b, '$.{path}')"


def _str(path: str) -> str:
    return f"json_extract_string(b, '$.{path}')"


def _dbl(path: str) -> str:
    return f"try_cast(json_extract_string(b, '$.{path}') AS double)"


def _text_issue(path: str, required: bool, longest: int | None = 255) -> str:
    req = f"WHEN {_kind(path)} IS NULL THEN {lit(path + ': required')}" if required else f"WHEN {_kind(path)} IS NULL THEN NULL"
    big = f"WHEN length({_str(path)}) > {longest} THEN {lit(path + ': too_big')}" if longest else ""
    return (
        f"CASE {req} WHEN {_kind(path)} <> 'VARCHAR' THEN {lit(path + ': invalid_type')} "
        f"WHEN length({_str(path)}) < 1 THEN {lit(path + ': too_small')} {big} END"
    )


def _object_issue(path: str) -> str:
    return f"CASE WHEN {_kind(path)} <> 'OBJECT' THEN {lit(path + ': invalid_type')} END"


def _int_issue(path: str, least: int, required: bool) -> str:
    req = lit(path + ": required") if required else "NULL"
    return (
        f"CASE WHEN {_kind(path)} IS NULL THEN {req} WHEN {_kind(path)} NOT IN {_NUM} THEN {lit(path + ': invalid_type')} "
        f"WHEN {_dbl(path)} <> floor({_dbl(path)}) THEN {lit(path + ': not_integer')} "
        f"WHEN {_dbl(path)} < {least} THEN {lit(path + ': too_small')} "
        f"WHEN {_dbl(path)} > 2147483647 THEN {lit(path + ': too_big')} END"
    )


def _word_issue(path: str, words: str, required: bool) -> str:
    req = lit(path + ": required") if required else "NULL"
    return (
        f"CASE WHEN {_kind(path)} IS NULL THEN {req} WHEN {_kind(path)} <> 'VARCHAR' THEN {lit(path + ': invalid_type')} "
        f"WHEN {_str(path)} NOT IN {words} THEN {lit(path + ': invalid_enum')} END"
    )


def _issues(checks: list[str]) -> str:
    found = f"array_to_string(list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL), '; ')"
    return f"CASE WHEN obj THEN {found} ELSE 'body: invalid_type' END"


def _requests(body: str) -> str:
    return f"""{EV}, raw AS (SELECT seq, cast(floor(seq / 3) AS bigint) AS batch_id, {body} AS body FROM ev),
      req AS (SELECT *, CASE WHEN json_valid(body) THEN body ELSE 'null' END AS b, {_OBJ} AS obj FROM raw)"""


_EVENT_ISSUES = _issues([
    f"CASE WHEN {_kind('event_id')} <> 'VARCHAR' THEN 'event_id: invalid_type' "
    f"WHEN NOT regexp_full_match({_str('event_id')}, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}') "
    "THEN 'event_id: invalid_uuid' END",
    _text_issue("event_type", True),
    _text_issue("source", True),
    f"CASE WHEN {_kind('timestamp')} IS NULL THEN 'timestamp: required' WHEN {_kind('timestamp')} <> 'VARCHAR' "
    "THEN 'timestamp: invalid_type' "
    f"WHEN NOT regexp_full_match({_str('timestamp')}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.][0-9]+)?Z') "
    f"OR try_cast({_str('timestamp')} AS timestamp) IS NULL THEN 'timestamp: invalid_datetime' END",
    _object_issue("payload"),
    _object_issue("metadata"),
])
_CHECKED = f"""{_requests(d.EVENT_BODY)}, checked AS (
  SELECT seq, batch_id,
    {', '.join(f"CASE WHEN obj THEN {_str(f)} END AS {lit_name}" for f, lit_name in
               (('event_id', 'event_id'), ('event_type', 'event_type'), ('source', 'source'), ('timestamp', '"timestamp"')))},
    {', '.join(f"coalesce(CASE WHEN obj THEN cast(json_extract(b, '$.{f}') AS varchar) END, '{{}}') AS {f}" for f in ('payload', 'metadata'))},
    {_EVENT_ISSUES} AS issues
  FROM req)"""
_ASSIGNED = d.uuid_of("concat_ws(chr(31), cast(seq AS varchar), event_type, source, \"timestamp\", payload)")
_GATED = f"""{_CHECKED}, gated AS (
  SELECT seq, batch_id, coalesce(event_id, {_ASSIGNED}) AS event_id, issues,
         bool_and(issues = '') OVER w AS batch_accepted, count(*) OVER w AS batch_size
  FROM checked WINDOW w AS (PARTITION BY batch_id))"""


def _rule_validation(body: str, required: set[str], extra: str | None, defaults: bool) -> str:
    def req(f: str) -> bool:
        return f in required

    inside = [
        _word_issue("condition.type", "('threshold')", True),
        _word_issue("condition.metric", "('count')", True),
        _object_issue("condition.filters"),
        _text_issue("condition.filters.event_type", False, None),
        _text_issue("condition.filters.source", False, None),
        _word_issue("condition.operator", "('>', '>=', '<', '<=', '==', '!=')", True),
        f"CASE WHEN {_kind('condition.value')} IS NULL THEN 'condition.value: required' "
        f"WHEN {_kind('condition.value')} NOT IN {_NUM} THEN 'condition.value: invalid_type' END",
    ]
    checks = [
        _text_issue("name", req("name")),
        f"CASE WHEN {_kind('enabled')} IS NULL THEN {lit('enabled: required') if req('enabled') else 'NULL'} "
        f"WHEN {_kind('enabled')} <> 'BOOLEAN' THEN 'enabled: invalid_type' END",
        _word_issue("severity", "('critical', 'warning', 'info')", req("severity")),
        _int_issue("window_seconds", 1, req("window_seconds")),
        _int_issue("cooldown_seconds", 0, req("cooldown_seconds")),
        f"CASE WHEN {_kind('condition')} IS NULL THEN {lit('condition: required') if req('condition') else 'NULL'} "
        f"WHEN {_kind('condition')} <> 'OBJECT' THEN 'condition: invalid_type' END",
        *[f"CASE WHEN {_kind('condition')} = 'OBJECT' THEN {c} END" for c in inside],
    ]
    if extra:
        checks.append(extra)
    enabled, cooldown = f"try_cast({_str('enabled')} AS boolean)", f"cast({_dbl('cooldown_seconds')} AS integer)"
    if defaults:
        enabled, cooldown = f"coalesce({enabled}, true)", f"coalesce({cooldown}, 0)"
    cols = {
        "name": _str("name"), "enabled": enabled, "severity": _str("severity"),
        "window_seconds": f"cast({_dbl('window_seconds')} AS integer)", "cooldown_seconds": cooldown,
        "f_type": _str("condition.filters.event_type"), "f_source": _str("condition.filters.source"),
        "operator": _str("condition.operator"), "value": _dbl("condition.value"),
    }
    return f"""WITH {_requests(body)}, checked AS (SELECT *, {_issues(checks)} AS issues FROM req)
      SELECT seq, {', '.join(f"CASE WHEN issues = '' THEN {e} END AS {c}" for c, e in cols.items())}, issues
      FROM checked"""


# ---- rules, profiles, detectors -------------------------------------------

_RULES = f"""rules AS (SELECT * FROM (VALUES {values(d.RULE_LIST)})
  r(rule_id, name, enabled, severity, window_s, cooldown_s, f_type, f_source, operator, value) WHERE enabled)"""
_MATCHES = f"""{EV}, {_RULES}, matches AS (
  SELECT r.rule_id, r.window_s * 1000 AS window_ms, e.event_id, e.ts_ms, e.seq
  FROM ev e JOIN rules r ON (r.f_type IS NULL OR r.f_type = e.event_type) AND (r.f_source IS NULL OR r.f_source = e.source))"""
_COUNTS = f"""{_MATCHES}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY ts_ms, seq) AS rn FROM matches),
  counts AS (
  SELECT *, rn - min(rn) OVER (PARTITION BY rule_id ORDER BY ts_ms RANGE BETWEEN window_ms PRECEDING AND CURRENT ROW) + 1 AS count
  FROM ranked)"""
_CANDIDATES = f"""{_COUNTS}, cands AS (
  SELECT c.rule_id, c.event_id, c.ts_ms, c.seq, c.count, r.cooldown_s * 1000 AS cooldown_ms, r.name, r.severity, r.operator, r.value
  FROM counts c JOIN rules r USING (rule_id)
  WHERE CASE r.operator WHEN '>' THEN c.count > r.value WHEN '>=' THEN c.count >= r.value WHEN '<' THEN c.count < r.value
        WHEN '<=' THEN c.count <= r.value WHEN '==' THEN c.count = r.value WHEN '!=' THEN c.count <> r.value ELSE false END)"""


def _fires(cands: str, key: str) -> str:
    """Cooldown: next allowed candidate per candidate, then follow from the first."""
    return f"""firsts AS (
      SELECT * FROM {cands} WHERE cooldown_ms = 0
      UNION ALL SELECT * FROM {cands} WHERE cooldown_ms > 0
        QUALIFY row_number() OVER (PARTITION BY {key}, ts_ms ORDER BY seq) = 1),
    steps AS (SELECT {key}, ts_ms, min(ts_ms) OVER (PARTITION BY {key} ORDER BY ts_ms
        RANGE BETWEEN cooldown_ms FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM firsts WHERE cooldown_ms > 0),
    chain AS (
      SELECT {key}, min(ts_ms) AS ts_ms FROM steps GROUP BY {key}
      UNION ALL SELECT s.{key}, s.nxt FROM chain c JOIN steps s ON s.{key} = c.{key} AND s.ts_ms = c.ts_ms WHERE s.nxt IS NOT NULL),
    fired AS (
      SELECT * FROM firsts WHERE cooldown_ms = 0
      UNION ALL SELECT f.* FROM firsts f JOIN chain c ON f.{key} = c.{key} AND f.ts_ms = c.ts_ms WHERE f.cooldown_ms > 0)"""


_PROFILES = f"""profiles AS (SELECT * FROM (VALUES {values(d.PROFILE_LIST)})
  p(profile_id, bucket_s, n, z_threshold, cooldown_s, f_type, f_source))"""
_WIDEST = max(p[2] for p in d.PROFILE_LIST)
_BASELINE = f"""{EV}, {_PROFILES}, hits AS (
  SELECT p.profile_id, cast(floor(e.ts_ms / (p.bucket_s * 1000)) AS bigint) AS bucket, e.event_id, e.ts_ms, e.seq
  FROM ev e JOIN profiles p ON (p.f_type IS NULL OR p.f_type = e.event_type) AND (p.f_source IS NULL OR p.f_source = e.source)),
  bucket_n AS (SELECT profile_id, bucket, count(*) AS count FROM hits GROUP BY ALL),
  recent AS (SELECT b.*, p.n, list({{'b': bucket, 'c': count}}) OVER (PARTITION BY profile_id ORDER BY bucket
      ROWS BETWEEN {_WIDEST} PRECEDING AND 1 PRECEDING) AS past FROM bucket_n b JOIN profiles p USING (profile_id)),
  usable AS (SELECT *, list_filter(past, lambda x: x.b >= bucket - (n + 1)) AS kept FROM recent),
  picked AS (SELECT *, list_transform(kept[-n:], lambda x: cast(x.c AS double)) AS base FROM usable WHERE len(kept) >= n),
  with_mean AS (SELECT *, list_reduce(base, lambda a, x: a + x) / n AS mean FROM picked),
  baseline AS (SELECT profile_id, bucket, count, mean,
      sqrt(list_reduce(list_transform(base, lambda x: (x - mean) * (x - mean)), lambda a, x: a + x) / n) AS stddev
    FROM with_mean)"""
_Z_CANDIDATES = f"""{_BASELINE}, zcands AS (
  SELECT h.profile_id, h.event_id, h.ts_ms, h.seq, h.bucket, h.current, b.mean, b.stddev, (h.current - b.mean) / b.stddev AS z,
         p.cooldown_s * 1000 AS cooldown_ms, p.bucket_s, p.f_type, p.f_source
  FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, bucket ORDER BY ts_ms, seq) AS current FROM hits) h
  JOIN baseline b USING (profile_id, bucket) JOIN profiles p USING (profile_id)
  WHERE b.stddev > 0 AND (h.current - b.mean) / b.stddev >= p.z_threshold)"""


def _r4(x: str) -> str:
    return number(f"(floor({x} * 10000.0 + 0.5) / 10000.0)")


_Z_MESSAGE = f"""'Z-score spike detected' ||
  CASE WHEN f_type IS NULL AND f_source IS NULL THEN '' ELSE ' (' ||
    concat_ws(', ', 'event_type=' || f_type, 'source=' || f_source) || ')' END ||
  ': z=' || {_r4('z')} || ', current=' || current || ', mean=' || {_r4('mean')} || ', stddev=' || {_r4('stddev')} ||
  ', bucketSeconds=' || bucket_s || ', bucketStart=' || {iso_ms('bucket * bucket_s * 1000')}"""

_RATE = f"""rate AS (
  SELECT event_id, 'rate-spike' AS rule_id, 'high' AS severity,
    'Rate spike: ' || n || ' events from source "' || source || '" in {d.RATE_SECONDS}s (threshold: {d.RATE_MAX})' AS message,
    iso AS detected_at
  FROM (SELECT *, rn - min(rn) OVER (PARTITION BY source ORDER BY ts_ms
          RANGE BETWEEN {d.RATE_SECONDS * 1000} PRECEDING AND CURRENT ROW) + 1 AS n
        FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts_ms, seq) AS rn FROM ev))
  WHERE n > {d.RATE_MAX})"""
_INVALID = """invalid AS (
  SELECT event_id, 'invalid-payload' AS rule_id, 'medium' AS severity,
    'Missing required payload fields for "' || event_type || '": ' || array_to_string(gone, ', ') AS message, iso AS detected_at
  FROM (SELECT *, list_filter(CASE event_type %s END,
          lambda f: json_extract_string(payload, '$.' || f) IS NULL) AS gone FROM ev)
  WHERE len(gone) > 0)""" % " ".join(f"WHEN {lit(t)} THEN [{', '.join(lit(f) for f in fs)}]" for t, fs in d.REQUIRED.items())
_AS_OF_MS = f"epoch_ms({AS_OF})"
_DRIFT_TEXT = f"""'Timestamp drift: ' || cast(floor(abs({_AS_OF_MS} - ts_ms) / 1000.0 + 0.5) AS bigint) || 's in the ' ||
  CASE WHEN ts_ms < {_AS_OF_MS} THEN 'past' ELSE 'future' END || ' (threshold: {d.DRIFT_SECONDS}s)'"""
_DRIFT = f"""drift AS (
  SELECT event_id, 'timestamp-drift' AS rule_id, 'low' AS severity, {_DRIFT_TEXT} AS message, '2024-01-31T00:00:00.000Z' AS detected_at
  FROM ev WHERE abs({_AS_OF_MS} - ts_ms) > {d.DRIFT_SECONDS * 1000})"""
_ANOMALY_COLUMNS = f"{anomaly_id()} AS anomaly_id, event_id, rule_id, severity, message, detected_at"
_STATELESS = f"""{EV}, {_INVALID}, {_DRIFT}, anomalies AS (
  SELECT {_ANOMALY_COLUMNS} FROM (SELECT * FROM invalid UNION ALL SELECT * FROM drift))"""


def _metrics(key: str, where: str = "true") -> str:
    w = d.MONTH_SECONDS
    return f"""{EV}, m AS (
      SELECT {w} AS window_seconds, '{key}' AS group_by, '2023-12-31T00:00:00.000Z' AS "from", '2024-01-31T00:00:00.000Z' AS "to",
             {key} AS key, count(*) AS count, floor((2 * count(*) * 10000 + {w}) / {2 * w}) / 10000.0 AS rate_per_sec
      FROM ev WHERE "timestamp" BETWEEN TIMESTAMP '2023-12-31 00:00:00' AND {AS_OF} AND {where} GROUP BY {key})"""


_CHANGES = f"""{EV}, changes AS (
  SELECT seq, iso AS "at", {', '.join(f'{e} AS {c}' for c, e in d.RULE_CHANGE.items())},
    ({d.CONDITION_SET}) AS has_condition, {d.CONDITION_TYPE} AS f_type, {d.CONDITION_SOURCE} AS f_source,
    {d.CONDITION_OPERATOR} AS operator, {d.CONDITION_VALUE} AS value FROM ev),
  gone AS (SELECT rule_id, max(seq) FILTER (WHERE reason = 'delete') AS d FROM changes GROUP BY rule_id),
  born AS (SELECT c.rule_id, min(c.seq) AS b FROM changes c JOIN gone g USING (rule_id)
           WHERE c.reason = 'create' AND c.seq > coalesce(g.d, -1) GROUP BY c.rule_id),
  live AS (SELECT c.* FROM changes c JOIN born USING (rule_id) WHERE c.seq = b OR (c.seq > b AND c.reason IN ('update', 'patch'))),
  current_rules AS (SELECT rule_id,
    {', '.join(f'arg_max({f}, seq) FILTER (WHERE {f} IS NOT NULL) AS {f}' for f in
               ('name', 'enabled', 'severity', 'window_seconds', 'cooldown_seconds'))},
    {', '.join(f"(list({f} ORDER BY seq DESC) FILTER (WHERE has_condition))[1] AS {f}" for f in
               ('f_type', 'f_source', 'operator', 'value'))},
    arg_min("at", seq) AS created_at, arg_max("at", seq) AS updated_at
    FROM live GROUP BY rule_id)"""

_OUTBOX_TARGET = {"websocket": ("pending", ""), "slack": ("skipped_no_url", ""), "email": ("pending", "ops,oncall")}
_OUTBOX_BODY = {
    "websocket": "to_json({'type': 'anomaly', 'severity': severity, 'message': message, 'detected_at': detected_at, "
                 "'anomaly_id': anomaly_id, 'rule_id': rule_id})",
    "slack": "to_json({'text': '*[' || upper(severity) || ']* Anomaly detected' || chr(10) || '>' || message || chr(10) || "
             "'Rule: `' || rule_id || '` | Detected: ' || detected_at})",
    "email": "to_json({'anomaly_id': anomaly_id, 'rule_id': rule_id, 'severity': severity, 'message': message, "
             "'detected_at': detected_at})",
}


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    ev = f"WITH {EV}"
    q["scan_events"] = f"{ev} SELECT {EVENT_COLUMNS} FROM ev"
    q["encode_events"] = f'{ev} SELECT seq, event_id, event_type, source, iso AS "timestamp", payload, metadata FROM ev'
    fields = {f: f"coalesce({e}, {lit('{}' if f in ('payload', 'metadata') else '')})" for f, e in d.ENTRY_FIELDS.items()}
    q["decode_events"] = f"""{ev}, x AS (SELECT seq, {', '.join(f'{e} AS "{f}"' for f, e in fields.items())} FROM ev)
      SELECT *, NOT (json_valid(payload) AND json_valid(metadata)) AS malformed FROM x"""
    q["dedup_events"] = f"""{ev}, copies AS (SELECT *, unnest({d.COPY_LIST.format('[', ']')}) AS copy FROM ev),
      resent AS (SELECT event_id, event_type, source, iso AS "timestamp", {d.COPY_PAYLOAD} AS payload, metadata,
                        iso AS created_at, {d.COPY_SEQ} AS seq FROM copies)
      SELECT * FROM resent QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq) = 1"""
    q["retention_events"] = f"""{ev} SELECT {EVENT_COLUMNS} FROM ev WHERE "timestamp" >= {AS_OF} - INTERVAL 15 DAY"""
    q["retention_anomalies"] = f"WITH {_STATELESS} SELECT * FROM anomalies WHERE detected_at >= '2024-01-11T00:00:00.000Z'"

    q["validate_events"] = f"WITH {_CHECKED} SELECT * EXCLUDE (batch_id) FROM checked"
    q["assign_event_id"] = f"WITH {_CHECKED} SELECT seq, coalesce(event_id, {_ASSIGNED}) AS event_id FROM checked WHERE issues = ''"
    q["batch_gate"] = f"WITH {_GATED} SELECT batch_id, seq, batch_accepted, batch_size FROM gated"
    q["batch_receipt"] = f"""WITH {_GATED}
      SELECT batch_id, 'accepted' AS status, batch_size AS count,
             row_number() OVER (PARTITION BY batch_id ORDER BY seq) - 1 AS position, event_id, cast(NULL AS varchar) AS issue
      FROM gated WHERE batch_accepted
      UNION ALL SELECT batch_id, 'rejected', batch_size, NULL, event_id, issues FROM gated WHERE NOT batch_accepted AND issues <> ''"""
    every = {"name", "enabled", "severity", "window_seconds", "cooldown_seconds", "condition"}
    q["validate_rules_create"] = _rule_validation(d.RULE_BODY, every - {"enabled", "cooldown_seconds"}, None, True)
    q["validate_rules_replace"] = _rule_validation(d.RULE_BODY, every, None, False)
    none = " AND ".join(f"{_kind(f)} IS NULL" for f in sorted(every))
    q["validate_rules_patch"] = _rule_validation(
        d.PATCH_BODY, set(), f"CASE WHEN {none} THEN 'body: no_fields' END", False
    )
    profile_issue = f"""array_to_string(list_filter([
        CASE WHEN id = '' THEN 'id: required' END,
        CASE WHEN isinf(bucket_seconds) OR bucket_seconds <= 0 THEN 'bucket_seconds: invalid' END,
        CASE WHEN baseline_buckets <> floor(baseline_buckets) OR baseline_buckets < 2 THEN 'baseline_buckets: invalid' END,
        CASE WHEN isnan(z_threshold) OR z_threshold <= 0 THEN 'z_threshold: invalid' END,
        CASE WHEN cooldown_seconds < 0 THEN 'cooldown_seconds: invalid' END], lambda x: x IS NOT NULL), '; ')"""
    q["validate_profiles"] = f"""{ev}, p AS (SELECT seq, {', '.join(f'{e} AS {c}' for c, e in d.PROFILE_COLUMNS.items())} FROM ev)
      SELECT seq, id, {profile_issue} AS issues FROM p"""
    note = ", ".join(f"json_extract_string(b, '$.{f}') AS {f}" for f in ("anomaly_id", "rule_id", "severity", "message", "detected_at"))
    q["valid_notifications"] = f"""WITH {_requests(d.NOTIFICATION_BODY)}, n AS (SELECT seq, {note} FROM req)
      SELECT * FROM n WHERE coalesce(anomaly_id, '') <> '' AND coalesce(rule_id, '') <> '' AND coalesce(severity, '') <> ''"""

    newest = "ORDER BY created_at DESC, event_id"
    q["list_events"] = f"{ev} SELECT {EVENT_COLUMNS} FROM (SELECT * FROM ev {newest} LIMIT 500 OFFSET 100)"
    q["list_events_filtered"] = f"""{ev} SELECT {EVENT_COLUMNS} FROM (SELECT * FROM ev
      WHERE event_type = 'error' AND source = 'user-7' {newest} LIMIT 500)"""
    q["list_events_range"] = f"""{ev} SELECT {EVENT_COLUMNS} FROM (SELECT * FROM ev
      WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' {newest} LIMIT 500 OFFSET 20)"""
    q["get_event"] = f"{ev} SELECT {EVENT_COLUMNS} FROM ev WHERE event_id = '424'"
    q["list_anomalies"] = f"""WITH {_STATELESS} SELECT * FROM anomalies WHERE rule_id = 'invalid-payload' AND severity = 'medium'
      ORDER BY detected_at DESC, anomaly_id LIMIT 200 OFFSET 10"""
    q["events_page_info"] = f"""{ev} SELECT 500 AS "limit", 3 AS "offset", count(*) AS count
      FROM (SELECT * FROM ev WHERE event_type = 'error' {newest} LIMIT 500 OFFSET 3)"""
    q["feed_last_24h"] = f"""{ev} SELECT {EVENT_COLUMNS} FROM (SELECT * FROM ev
      WHERE "timestamp" >= TIMESTAMP '2024-01-29' {newest} LIMIT 100)"""
    q["anomaly_timeline"] = f"""WITH {_STATELESS} SELECT * FROM anomalies WHERE severity = 'low'
      ORDER BY detected_at DESC, anomaly_id LIMIT 100"""
    q["anomaly_drilldown"] = f"""WITH {_STATELESS} SELECT a.*, e.event_type, e.source, e.iso AS event_time, e.payload
      FROM anomalies a LEFT JOIN (SELECT * FROM ev WHERE "timestamp" >= {AS_OF} - INTERVAL 20 DAY) e USING (event_id)"""

    q["metrics_by_type"] = f"WITH {_metrics('event_type')} SELECT * FROM m"
    q["metrics_by_source"] = f"""WITH {_metrics('source', "event_type = 'error'")} SELECT * FROM m"""
    bad = "lower(key) LIKE '%error%' OR lower(key) LIKE '%fail%'"
    q["error_rate"] = f"""WITH {_metrics('event_type')}, s AS (
        SELECT cast(coalesce(sum(count) FILTER (WHERE {bad}), 0) AS bigint) AS error_count, cast(sum(count) AS bigint) AS total_count FROM m),
      g AS (SELECT *, error_count / total_count * 100.0 AS error_pct FROM s WHERE total_count IS NOT NULL)
      SELECT *, CASE WHEN error_pct < 1 THEN 'Healthy' WHEN error_pct < 5 THEN 'Warning' ELSE 'Critical' END AS status FROM g"""
    q["top_events"] = f"WITH {_metrics('source')} SELECT key, count, rate_per_sec FROM m ORDER BY count DESC, key"
    q["throughput"] = f"WITH {_metrics('event_type')} SELECT key, rate_per_sec, count FROM m"
    q["bucket_counts"] = f"""{ev} SELECT cast(floor(ts_ms / 600000) AS bigint) * 600000 AS bucket_start_ms, count(*) AS count
      FROM ev GROUP BY 1"""

    q["apply_rule_changes"] = f"WITH {_CHANGES} SELECT * FROM current_rules"
    q["rules_all"] = f"WITH {_CHANGES} SELECT rule_id, name, enabled, severity FROM current_rules"
    q["rules_enabled"] = f"WITH {_CHANGES} SELECT rule_id, name FROM current_rules WHERE enabled"

    q["rule_matches"] = f"WITH {_MATCHES} SELECT rule_id, event_id FROM matches"
    q["sliding_rule_counts"] = q["sliding_rule_counts_bounded"] = f"WITH {_COUNTS} SELECT rule_id, event_id, count FROM counts"
    started = _COUNTS.replace("FROM matches)", "FROM matches WHERE ts_ms >= epoch_ms(TIMESTAMP '2024-01-10'))")
    q["sliding_rule_counts_since"] = f"WITH {started} SELECT rule_id, event_id, count FROM counts"
    q["threshold_candidates"] = f"WITH {_CANDIDATES} SELECT rule_id, event_id, count FROM cands"
    q["threshold_anomalies"] = q["threshold_anomalies_bounded"] = f"""WITH RECURSIVE {_CANDIDATES}, {_fires('cands', 'rule_id')}
      SELECT {anomaly_id()} AS anomaly_id, event_id, rule_id, severity,
        'Threshold rule "' || name || '" triggered: count(' || count || ') ' || operator || ' ' || {number('value')} AS message,
        {iso_ms('ts_ms')} AS detected_at FROM fired"""
    q["zscore_baseline"] = f"WITH {_BASELINE} SELECT * FROM baseline"
    q["zscore_candidates"] = f"WITH {_Z_CANDIDATES} SELECT profile_id, event_id, current, mean, stddev, z FROM zcands"
    q["zscore_anomalies"] = f"""WITH RECURSIVE {_Z_CANDIDATES}, {_fires('zcands', 'profile_id')},
      named AS (SELECT *, 'stat-' || profile_id AS rule_id FROM fired)
      SELECT {anomaly_id()} AS anomaly_id, event_id, rule_id, 'warning' AS severity, {_Z_MESSAGE} AS message,
        {iso_ms('ts_ms')} AS detected_at FROM named"""
    renamed = q["zscore_anomalies"].replace("'stat-' || profile_id", "profile_id")
    q["stream_anomalies"] = f"SELECT * FROM ({q['threshold_anomalies']}) UNION ALL SELECT * FROM ({renamed})"

    q["stream_threshold_state"], q["stream_zscore_state"] = q["threshold_anomalies"], q["zscore_anomalies"]
    q["stream_anomalies_with_copies"] = f"""SELECT * REPLACE (split_part(event_id, chr(31), 1) AS event_id)
      FROM ({q['stream_anomalies'].replace(EV, _EV_COPIES)})"""
    q["stream_dedup"] = f"SELECT * EXCLUDE (created_at) FROM ({q['dedup_events']})"
    q["stream_new_only"] = f"{ev}, {_PARTS} SELECT event_id, seq FROM parts WHERE part >= 4"
    places = values(enumerate((1, 0, 2, 4, 3, 5, 7, 6)))
    q["stream_late"] = f"""{ev}, {_PARTS}, ends AS (SELECT place, part, max(ts_ms) AS hi FROM parts JOIN (VALUES {places}) o(place, part) USING (part) GROUP BY ALL),
      limits AS (SELECT part, max(hi) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600000 AS least FROM ends)
      SELECT event_id, coalesce(ts_ms < least, false) AS late FROM parts JOIN limits USING (part)"""
    q["stream_rule_added"] = f"""{ev}, {_PARTS} SELECT a.* FROM ({q['threshold_anomalies']}) a JOIN parts USING (event_id)
      WHERE part >= 4 OR a.rule_id NOT IN ({', '.join(map(lit, d.ADDED_RULES))})"""

    q["stream_rule_table"], q["metrics_from_rollup"] = q["apply_rule_changes"], q["metrics_by_type"]
    q["buckets_from_rollup"] = f"""{ev} SELECT cast(floor(ts_ms / 600000) AS bigint) * 600000 AS bucket_start_ms, count(*) AS count
      FROM ev WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-01 00:01:30' AND {AS_OF} GROUP BY 1"""
    q["retention_stored_events"] = f"""{ev} SELECT {EVENT_COLUMNS} FROM ev WHERE "timestamp" >= {AS_OF} - INTERVAL 10 HOUR - INTERVAL 15 DAY"""
    q["retention_stored_anomalies"] = f"""WITH {_STATELESS} SELECT * FROM anomalies
      WHERE rule_id = 'invalid-payload' AND detected_at >= '2024-01-10T14:00:00.000Z'"""
    default = [("zscore-count-spike", 10, 5, 2.0, 30, None, None)]
    for name, like, profiles in (
        ("zscore_baseline_wide", "zscore_baseline", d.DENSE_PROFILES), ("zscore_anomalies_wide", "zscore_anomalies", d.DENSE_PROFILES),
        ("zscore_default_profile", "zscore_anomalies", default),
    ):
        q[name] = (
            q[like].replace(EV, _EV_DENSE).replace(values(d.PROFILE_LIST), values(profiles))
            .replace(f"ROWS BETWEEN {_WIDEST} PRECEDING", f"ROWS BETWEEN {max(p[2] for p in profiles)} PRECEDING"))
    q["zscore_default_profile"] = q["zscore_default_profile"].replace("'stat-' || profile_id", "profile_id")

    q["rate_spike"] = f"{ev}, {_RATE} SELECT {_ANOMALY_COLUMNS} FROM rate"
    q["invalid_payload"] = f"{ev}, {_INVALID} SELECT {_ANOMALY_COLUMNS} FROM invalid"
    q["timestamp_drift"] = f"""{ev}, raws AS (SELECT *, {d.ENTRY_FIELDS['timestamp']} AS raw FROM ev),
      hits AS (SELECT event_id, 'timestamp-drift' AS rule_id, 'low' AS severity,
        CASE WHEN raw IS NULL THEN 'Unparseable timestamp: "not-a-date"' ELSE {_DRIFT_TEXT} END AS message,
        '2024-01-31T00:00:00.000Z' AS detected_at
        FROM raws WHERE raw IS NULL OR abs({_AS_OF_MS} - ts_ms) > {d.DRIFT_SECONDS * 1000})
      SELECT {_ANOMALY_COLUMNS} FROM hits"""
    q["builtin_anomalies"] = f"""{ev}, {_RATE}, {_INVALID}, {_DRIFT}
      SELECT {_ANOMALY_COLUMNS} FROM (SELECT * FROM rate UNION ALL SELECT * FROM invalid UNION ALL SELECT * FROM drift)"""
    pack_message = (
        f"'Timestamp drift: ' || cast(floor(abs({_AS_OF_MS} - ts_ms) / 1000.0 + 0.5) AS bigint) || 's in the past (threshold: 300s)'")
    q["default_pack"] = f"""{ev}, hits AS (SELECT event_id, 'timestamp-drift' AS rule_id, 'low' AS severity, {pack_message} AS message,
        '2024-01-31T00:00:00.000Z' AS detected_at FROM ev WHERE abs({_AS_OF_MS} - ts_ms) > 300000)
      SELECT {_ANOMALY_COLUMNS} FROM hits"""
    rows = " UNION ALL ".join(
        f"SELECT anomaly_id, rule_id, severity, '{c}' AS channel, '{s}' AS status, '{t}' AS target, "
        f"cast({_OUTBOX_BODY[c]} AS varchar) AS body FROM anomalies"
        for c, (s, t) in _OUTBOX_TARGET.items()
    )
    q["notification_outbox"] = q["stream_notifications"] = f"WITH {_STATELESS} {rows}"
    q["notification_message"] = f"""WITH {_STATELESS} SELECT cast({_OUTBOX_BODY["email"]} AS varchar) AS message FROM anomalies"""
    q["change_messages"] = f"""WITH {_CHANGES} SELECT cast(to_json({{'ts': "at", 'reason': reason, 'rule_id': rule_id}}) AS varchar) AS message FROM changes"""
    q["get_rule"] = f"WITH {_CHANGES} SELECT rule_id, name, severity FROM current_rules WHERE rule_id = {lit(d.RULE_ID)}"
    q["zscore_details"] = f"""WITH RECURSIVE {_Z_CANDIDATES}, {_fires('zcands', 'profile_id')}
      SELECT event_id, profile_id, {iso_ms('bucket * bucket_s * 1000')} AS bucket_start, cast(bucket_s AS double) AS bucket_seconds,
        current AS current_count, n AS baseline_buckets, floor(mean * 10000.0 + 0.5) / 10000.0 AS mean,
        floor(stddev * 10000.0 + 0.5) / 10000.0 AS stddev, floor(z * 10000.0 + 0.5) / 10000.0 AS z, f_type, f_source
      FROM fired JOIN (SELECT profile_id, n FROM profiles) USING (profile_id)"""
    return q

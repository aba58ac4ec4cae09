"""Inputs the registered queries derive from the driver's ``events`` table.

The driver's tables hold clean events. Requests, change logs, resent copies and
so on are built from every event row by plain expressions, so they grow with the
table. The expression texts are valid in both engines; ``k`` is the number in the
event's props and picks the defects.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import iso_millis
from ..schemas import PROFILES, RULES
from ..sources.tables import bind_events

AS_OF = datetime(2024, 1, 31, tzinfo=timezone.utc)
MONTH_SECONDS = 31 * 86400


def uuid_of(expr: str) -> str:
    h = f"md5({expr})"
    return " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


EVENT_BODY = f"""
CASE WHEN k = 97 THEN 'not json' WHEN k = 98 THEN '[]' ELSE '{{' ||
  CASE WHEN k % 20 = 1 THEN '"event_id":"not-a-uuid",' WHEN k % 5 = 0 THEN ''
       ELSE '"event_id":"' || {uuid_of('event_id')} || '",' END ||
  CASE WHEN k = 23 THEN '' WHEN k = 3 THEN '"event_type":"",' WHEN k = 13 THEN '"event_type":5,'
       ELSE '"event_type":"' || event_type || '",' END ||
  CASE WHEN k = 7 THEN '"source":"' || repeat('x', 256) || '",' WHEN k = 17 THEN '"source":null,'
       WHEN k = 27 THEN '"source":"' || repeat('y', 255) || '",' ELSE '"source":"' || source || '",' END ||
  CASE WHEN k = 11 THEN '"timestamp":"2024-13-45T00:00:00Z"' WHEN k = 31 THEN '"timestamp":"2024-01-01T00:00:00+02:00"'
       WHEN k = 51 THEN '"timestamp":"yesterday"' WHEN k = 71 THEN '"timestamp":1704067200'
       WHEN k = 91 THEN '"timestamp":"2023-02-29T00:00:00Z"' ELSE '"timestamp":"' || iso || '"' END ||
  CASE WHEN k = 29 THEN ',"payload":[1]' WHEN k = 39 THEN ',"payload":"text"' WHEN k % 4 = 0 THEN ''
       ELSE ',"payload":' || payload END ||
  CASE WHEN k % 6 = 0 THEN ',"metadata":{{}}' WHEN k = 59 THEN ',"metadata":null' ELSE '' END || '}}' END
"""

RULE_BODY = """
CASE WHEN k = 96 THEN 'null' WHEN k = 86 THEN '{oops' ELSE '{' ||
  CASE WHEN k = 2 THEN '"name":"",' WHEN k = 3 THEN '' WHEN k = 4 THEN '"name":' || cast(seq AS string) || ','
       ELSE '"name":"watch ' || source || '",' END ||
  CASE WHEN k % 5 = 0 THEN '' WHEN k = 33 THEN '"enabled":"yes",' WHEN k % 2 = 0 THEN '"enabled":true,'
       ELSE '"enabled":false,' END ||
  CASE WHEN k = 12 THEN '"severity":"high",' WHEN k % 3 = 0 THEN '"severity":"critical",'
       WHEN k % 3 = 1 THEN '"severity":"warning",' ELSE '"severity":"info",' END ||
  CASE WHEN k = 22 THEN '"window_seconds":0,' WHEN k = 32 THEN '"window_seconds":1.5,'
       WHEN k = 42 THEN '"window_seconds":"60",' WHEN k = 62 THEN '"window_seconds":3000000000,' ELSE '"window_seconds":' || cast(60 * (1 + k) AS string) || ',' END ||
  CASE WHEN k = 52 THEN '"cooldown_seconds":-1,' WHEN k = 82 THEN '"cooldown_seconds":2147483648,' WHEN k % 8 = 0 THEN '' ELSE '"cooldown_seconds":' || cast(k AS string) || ',' END ||
  CASE WHEN k = 43 THEN '"other":1' WHEN k = 93 THEN '"condition":[]' ELSE '"condition":{"type":"threshold",' ||
    CASE WHEN k = 73 THEN '"metric":"sum",' ELSE '"metric":"count",' END ||
    CASE WHEN k = 83 THEN '"filters":{"event_type":""},' WHEN k % 4 = 0 THEN '"filters":{"source":"' || source || '"},'
         WHEN k % 4 = 1 THEN '' ELSE '"filters":{"event_type":"' || event_type || '"},' END ||
    CASE WHEN k = 53 THEN '"operator":"=>",' ELSE '"operator":">=",' END ||
    CASE WHEN k = 63 THEN '"value":"10"' WHEN k = 64 THEN '"value":2.5' ELSE '"value":' || cast(k AS string) END || '}' END || '}' END
"""

PATCH_BODY = """
CASE WHEN k = 96 THEN '[1]' WHEN k % 6 = 0 THEN '{}' WHEN k % 6 = 1 THEN '{"unknown":' || cast(k AS string) || '}'
  WHEN k % 6 = 2 THEN '{"enabled":' || CASE WHEN k % 4 = 2 THEN 'true' ELSE 'null' END || '}'
  WHEN k % 6 = 3 THEN '{"window_seconds":' || CASE WHEN k = 63 THEN '3000000000' ELSE cast(k - 30 AS string) END || ',"severity":"info"}'
  WHEN k % 6 = 4 THEN '{"cooldown_seconds":' || cast(k - 50 AS string) || ',"name":"' || source || '"}'
  ELSE '{"condition":{"type":"threshold","metric":"count","operator":"<","value":' || cast(k AS string) || '}}' END
"""

NOTIFICATION_BODY = f"""
CASE WHEN k = 5 THEN 'broken {{' WHEN k = 6 THEN '{{}}' ELSE '{{"anomaly_id":"' ||
  CASE WHEN k = 7 THEN '' ELSE {uuid_of('event_id')} END || '","rule_id":"' || CASE WHEN k = 8 THEN '' ELSE event_type END ||
  '",' || CASE WHEN k = 9 THEN '' ELSE '"severity":"warning",' END || '"message":"seen ' || source ||
  '","detected_at":"' || iso || '"}}' END
"""

# Columns of a rule change; a patch leaves some fields null.
RULE_CHANGE = {
    "rule_id": "'rule-' || source",
    "reason": """CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'update'
                 WHEN 'error' THEN 'delete' ELSE 'patch' END""",
    "name": "CASE WHEN {patch} AND k % 2 = 0 THEN NULL ELSE 'watch ' || source || ' ' || cast(k AS string) END",
    "enabled": "CASE WHEN {patch} AND k % 3 = 0 THEN NULL ELSE k % 4 <> 0 END",
    "severity": """CASE WHEN {patch} AND k % 5 <> 0 THEN NULL WHEN k % 3 = 0 THEN 'critical'
                   WHEN k % 3 = 1 THEN 'warning' ELSE 'info' END""",
    "window_seconds": "CASE WHEN {patch} AND k % 7 <> 0 THEN NULL ELSE cast(60 * (1 + k % 10) AS int) END",
    "cooldown_seconds": "CASE WHEN {patch} AND k % 2 = 1 THEN NULL ELSE cast(30 * (k % 5) AS int) END",
}
RULE_CHANGE = {c: e.format(patch="event_type IN ('view', 'click')") for c, e in RULE_CHANGE.items()}
RULE_ID = "rule-user-7"
CONDITION_SET = "NOT (event_type IN ('view', 'click')) OR k % 6 = 0"
CONDITION_TYPE = "CASE WHEN k % 2 = 0 THEN 'error' END"
CONDITION_SOURCE = "CASE WHEN k % 3 = 0 THEN source END"
CONDITION_OPERATOR = "CASE WHEN k % 2 = 0 THEN '>' ELSE '<=' END"
CONDITION_VALUE = "cast(k AS double) / 2"

PROFILE_COLUMNS = {
    "id": "CASE WHEN k % 11 = 0 THEN '' ELSE 'profile-' || cast(seq AS string) END",
    "bucket_seconds": "CASE WHEN k = 50 THEN cast('Infinity' AS double) ELSE cast(k - 5 AS double) END",
    "baseline_buckets": "cast(k % 9 AS double) / 2 + 1",
    "z_threshold": "CASE WHEN k = 60 THEN cast('NaN' AS double) ELSE cast(k % 5 AS double) - 0.5 END",
    "cooldown_seconds": "CASE WHEN k % 3 = 0 THEN NULL ELSE cast(k - 10 AS double) END",
}

# Copies of an event: some resent later, some resent with an earlier arrival number.
COPY_LIST = "CASE WHEN k % 9 = 0 THEN {0}0, 1, 2{1} WHEN k % 7 = 0 THEN {0}0, -1{1} ELSE {0}0{1} END"
COPY_SEQ = "seq + copy * 10000000000"
COPY_PART = "2 * (1 + floor(seq / 10000000000)) + CASE WHEN seq % 10000000000 % 7 < 3 THEN 0 ELSE 1 END"
COPY_PAYLOAD = "CASE WHEN copy = 0 THEN payload ELSE '{\"copy\":' || cast(copy AS string) || '}' END"

RULE_LIST = [
    # id, name, enabled, severity, window s, cooldown s, type, source, operator, value
    ("r-error-burst", "error burst", True, "warning", 3600, 7200, "error", None, ">", 2.0),
    ("r-volume-1h", "hourly volume", True, "critical", 3600, 3600, None, None, ">", 20.0),
    ("r-volume-10m", "short volume", True, "critical", 600, 1800, None, None, ">", 5.0),
    ("r-user-day", "busy user", True, "info", 86400, 0, None, "user-7", ">=", 3.0),
    ("r-user-type", "user clicks", True, "info", 172800, 60, "click", "user-7", "!=", 1.0),
    ("r-signup-slow", "few signups", True, "info", 3600, 86400, "signup", None, "<=", 1.0),
    ("r-view-below", "views below", True, "info", 900, 600, "view", None, "<", 1.5),
    ("r-purchase-two", "two purchases", True, "warning", 1800, 300, "purchase", None, "==", 2.0),
    ("r-exact", "exact value", True, "info", 600, 0, "purchase", "user-3", ">", 0.0012345678901234567),
    ("r-unknown-op", "unknown operator", True, "info", 60, 0, None, None, "~", 1.0),
    ("r-off", "switched off", False, "critical", 3600, 0, None, None, ">", 0.0),
]

# Rules that come in while a stream runs; without a cooldown, so what they find doesn't depend on the past.
ADDED_RULES = ("r-user-day", "r-exact")

PROFILE_LIST = [
    # id, bucket s, baseline buckets, z, cooldown s, type, source
    ("z-all-10m", 600, 5, 2.0, 0, None, None),
    ("z-all-1h", 3600, 5, 2.0, 7200, None, None),
    ("z-error-1h", 3600, 8, 1.5, 10800, "error", None),
    ("z-user-day", 86400, 3, 1.5, 0, None, "user-7"),
]

# Times of events close to one another, and profiles that suit them: some of many buckets, one that never has
# enough of them.
DENSE_MS = "1704067200000 + seq * 330 + seq % 7 * 40"
DENSE_PROFILES = [
    ("z-second", 1, 5, 1.0, 0, None, None),
    ("z-wide", 1, 200, 1.5, 30, None, None),
    ("z-wide-error", 5, 70, 1.5, 0, "error", None),
    ("z-endless", 1, 50000, 1.0, 0, None, None),
]

REQUIRED = {"error": ["k", "code"], "view": ["k"], "click": ["url", "k"]}
DRIFT_SECONDS = 15 * 86400
RATE_SECONDS, RATE_MAX = 86400, 5
CHANNELS = {
    "websocket": {"enabled": True},
    "slack": {"enabled": True, "webhook_url": ""},
    "email": {"enabled": True, "smtp_host": "mail", "recipients": ["ops", "oncall"]},
}


def events_with_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind_events(spark, sf_dir).withColumn(
        "k", F.get_json_object("payload", "$.k").cast("int")
    ).withColumn("iso", iso_millis(F.col("timestamp")))


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies in batches of three."""
    return events_with_k(spark, sf_dir).select(
        "seq", F.floor(F.col("seq") / 3).alias("batch_id"), F.expr(EVENT_BODY).alias("body")
    )


def bodies(spark: SparkSession, sf_dir: str, expr: str, name: str = "body") -> DataFrame:
    return events_with_k(spark, sf_dir).select("seq", F.expr(expr).alias(name))


def rule_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = F.when(
        F.expr(CONDITION_SET),
        F.struct(
            F.lit("threshold").alias("type"),
            F.lit("count").alias("metric"),
            F.struct(
                F.expr(CONDITION_TYPE).alias("event_type"), F.expr(CONDITION_SOURCE).alias("source")
            ).alias("filters"),
            F.expr(CONDITION_OPERATOR).alias("operator"),
            F.expr(CONDITION_VALUE).alias("value"),
        ),
    )
    return events_with_k(spark, sf_dir).select(
        "seq", F.col("timestamp").alias("at"),
        *[F.expr(e).alias(c) for c, e in RULE_CHANGE.items()],
        condition.alias("condition"),
    )


def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_with_k(spark, sf_dir).select(
        "seq", *[F.expr(e).alias(c) for c, e in PROFILE_COLUMNS.items()]
    )


def resent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = F.explode(F.expr(COPY_LIST.format("array(", ")")))
    return (
        events_with_k(spark, sf_dir)
        .withColumn("copy", copies)
        .withColumn("copy", F.col("copy").cast("bigint"))
        .withColumn("payload", F.expr(COPY_PAYLOAD))
        .withColumn("seq", F.expr(COPY_SEQ))
        .drop("k", "iso", "copy")
    )


def resent_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resent events with the part of the log they go to: in the order of their arrival numbers, no id
    twice in a part."""
    return resent_events(spark, sf_dir).withColumn("part", F.expr(COPY_PART))


def stream_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded entries with some fields left out and some objects cut short."""
    pairs = []
    for name, expr in ENTRY_FIELDS.items():
        pairs += [F.lit(name), F.expr(expr)]
    return events_with_k(spark, sf_dir).select(
        "seq", F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("fields")
    )


ENTRY_FIELDS = {
    "event_id": "CASE WHEN k % 13 = 0 THEN NULL ELSE event_id END",
    "event_type": "CASE WHEN k % 17 = 0 THEN NULL ELSE event_type END",
    "source": "CASE WHEN k % 19 = 0 THEN NULL ELSE source END",
    "timestamp": "CASE WHEN k % 23 = 0 THEN NULL ELSE iso END",
    "payload": "CASE WHEN k % 29 = 0 THEN NULL WHEN k % 31 = 0 THEN '{\"k\": ' ELSE payload END",
    "metadata": "CASE WHEN k % 2 = 0 THEN NULL ELSE metadata END",
}


def dense_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events close to one another: some three a second, in their order."""
    return bind_events(spark, sf_dir).withColumn("timestamp", F.timestamp_millis(F.expr(DENSE_MS)))


def _literal(v) -> str:
    if v is None:
        return "cast(NULL AS string)"
    return f"'{v}'" if isinstance(v, str) else str(v)


def _local_table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A control table as literal rows, which the planner can see and size."""
    listed = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({names})")


def rule_table(spark: SparkSession) -> DataFrame:
    flat = _local_table(
        spark, RULE_LIST,
        "rule_id, name, enabled, severity, window_seconds, cooldown_seconds, f_type, f_source, operator, value",
    )
    condition = F.struct(
        F.lit("threshold").alias("type"),
        F.lit("count").alias("metric"),
        F.struct(F.col("f_type").alias("event_type"), F.col("f_source").alias("source")).alias("filters"),
        "operator",
        F.col("value").cast("double").alias("value"),
    )
    return flat.withColumn("condition", condition).select(
        *RULES.fieldNames()[:7],
        *[F.lit(None).cast("timestamp").alias(c) for c in ("created_at", "updated_at")],
    )


def profile_list(spark: SparkSession, profiles: list[tuple] = PROFILE_LIST) -> DataFrame:
    names = "id, bucket_seconds, baseline_buckets, z_threshold, cooldown_seconds, f_type, f_source"
    flat = _local_table(spark, profiles, names)
    return flat.select(
        "id",
        *[F.col(c).cast("double").alias(c) for c in PROFILES.fieldNames()[1:5]],
        F.struct(F.col("f_type").alias("event_type"), F.col("f_source").alias("source")).alias("filters"),
    )

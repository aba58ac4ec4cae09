"""Canonical table schemas. Never inferred, always declared."""

from __future__ import annotations

from pyspark.sql import types as T

EVENTS = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("payload", T.StringType(), False),
    T.StructField("metadata", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("seq", T.LongType(), False),
])

STREAM_ENTRY = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
])

ANOMALIES = T.StructType([
    T.StructField("anomaly_id", T.StringType(), False),
    T.StructField("event_id", T.StringType(), False),
    T.StructField("rule_id", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("message", T.StringType(), False),
    T.StructField("detected_at", T.TimestampType(), False),
])

FILTERS = T.StructType([
    T.StructField("event_type", T.StringType()),
    T.StructField("source", T.StringType()),
])

CONDITION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("filters", FILTERS),
    T.StructField("operator", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

RULES = T.StructType([
    T.StructField("rule_id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("enabled", T.BooleanType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("window_seconds", T.IntegerType(), False),
    T.StructField("cooldown_seconds", T.IntegerType(), False),
    T.StructField("condition", CONDITION, False),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

PROFILES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("bucket_seconds", T.DoubleType()),
    T.StructField("baseline_buckets", T.DoubleType()),
    T.StructField("z_threshold", T.DoubleType()),
    T.StructField("cooldown_seconds", T.DoubleType()),
    T.StructField("filters", FILTERS),
])

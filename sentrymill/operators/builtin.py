"""Built-in detectors: rate per source, required payload keys, clock drift."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import anomaly_id, number_text
from ..sources.tables import with_ms
from .ranking import GROUP_ROWS, trailing_counts

# Defaults of the built-in detectors.
RATE_MAX_EVENTS = 50
RATE_WINDOW_SECONDS = 60
MAX_DRIFT_SECONDS = 300
REQUIRED_FIELDS = {
    "page_view": ["url"],
    "button_click": ["url", "element_id"],
    "form_submit": ["url", "form_name"],
}


def _anomaly(df: DataFrame, rule_id: str, severity: str, message: Column, detected_at: Column) -> DataFrame:
    return df.select(
        anomaly_id(F.lit(rule_id), F.col("event_id")).alias("anomaly_id"),
        "event_id",
        F.lit(rule_id).alias("rule_id"),
        F.lit(severity).alias("severity"),
        message.alias("message"),
        detected_at.alias("detected_at"),
    )


def rate_spike(
    events: DataFrame,
    max_events: int = RATE_MAX_EVENTS,
    window_seconds: int = RATE_WINDOW_SECONDS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """More than ``max_events`` events of one source within the trailing window."""
    slim = with_ms(events).select(
        "event_id", "source", "ts_ms", "seq", F.lit(window_seconds * 1000).cast("bigint").alias("window_ms")
    )
    counted = trailing_counts(slim, ["source"], "window_ms", group_rows=group_rows).filter(
        F.col("count") > max_events
    )
    message = F.concat(
        F.lit("Rate spike: "), F.col("count").cast("string"), F.lit(' events from source "'), "source",
        F.lit(f'" in {window_seconds}s (threshold: {max_events})'),
    )
    return _anomaly(counted, "rate-spike", "high", message, F.timestamp_millis("ts_ms"))


def invalid_payload(events: DataFrame, required: dict[str, list[str]] | None = None) -> DataFrame:
    """Known event types whose payload lacks a required key or has it null, the
    missing keys in declared order. Other types pass."""
    required = REQUIRED_FIELDS if required is None else required
    have = F.from_json("payload", "map<string,string>")
    known = events.filter(F.col("event_type").isin(*required)).withColumn("_have", have)
    missing = reduce(
        lambda rest, kv: F.when(
            F.col("event_type") == kv[0],
            F.filter(
                F.array(*[F.lit(k) for k in kv[1]]).cast("array<string>"),
                lambda k: F.try_element_at(F.col("_have"), k).isNull(),
            ),
        ).otherwise(rest),
        required.items(),
        F.array().cast("array<string>"),
    )
    hits = known.withColumn("_missing", missing).filter(F.size("_missing") > 0)
    message = F.concat(
        F.lit('Missing required payload fields for "'), "event_type", F.lit('": '), F.array_join("_missing", ", ")
    )
    return _anomaly(hits, "invalid-payload", "medium", message, F.col("timestamp"))


def timestamp_drift(
    events: DataFrame,
    as_of: datetime,
    max_drift_seconds: int = MAX_DRIFT_SECONDS,
    raw: str | None = None,
) -> DataFrame:
    """Events more than the allowed seconds from ``as_of``, past or future.

    ``raw`` names a text column that still holds the time as sent; a text that is
    no time is an anomaly of its own.
    """
    stamp = F.col("timestamp") if raw is None else F.try_to_timestamp(F.col(raw))
    now_ms = F.unix_millis(F.lit(as_of))
    timed = events.withColumn("_ms", F.unix_millis(stamp)).withColumn("_drift", F.abs(now_ms - F.col("_ms")))
    hits = timed.filter(F.col("_ms").isNull() | (F.col("_drift") > max_drift_seconds * 1000))
    seconds = F.floor(F.col("_drift") / 1000 + F.lit(0.5)).cast("string")
    drift = F.concat(
        F.lit("Timestamp drift: "), seconds, F.lit("s in the "),
        F.when(F.col("_ms") < now_ms, "past").otherwise("future"),
        F.lit(" (threshold: "), number_text(F.lit(float(max_drift_seconds))), F.lit("s)"),
    )
    text = F.lit(None).cast("string") if raw is None else F.col(raw)
    unparsed = F.concat(F.lit('Unparseable timestamp: "'), F.coalesce(text, F.lit("")), F.lit('"'))
    message = F.when(F.col("_ms").isNull(), unparsed).otherwise(drift)
    return _anomaly(hits, "timestamp-drift", "low", message, F.lit(as_of))


Detector = Callable[[DataFrame], DataFrame]


def default_pack(as_of: datetime) -> dict[str, Detector]:
    """The default detectors by id. Setting an id again replaces its detector."""
    return {
        "rate-spike": lambda ev: rate_spike(ev),
        "invalid-payload": lambda ev: invalid_payload(ev),
        "timestamp-drift": lambda ev: timestamp_drift(ev, as_of),
    }


def run_pack(events: DataFrame, pack: dict[str, Detector]) -> DataFrame:
    """All anomalies of all detectors in the pack."""
    return reduce(DataFrame.unionByName, (detect(events) for detect in pack.values()))

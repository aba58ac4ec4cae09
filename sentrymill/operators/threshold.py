"""User-defined threshold rules: sliding count per rule, comparison, cooldown.

Batch order is event time with ``seq`` for ties, which equals arrival order when
events arrive in order. The clock is the event's own timestamp.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import anomaly_id, number_text
from ..sources.tables import with_ms
from .cooldown import DIRECT_ROWS, apply_cooldown
from .joins import Control, attach_control, match_filters, prepare_control
from .ranking import GROUP_ROWS, trailing_counts


# The six comparisons.
OPERATORS = (">", ">=", "<", "<=", "==", "!=")


def rule_control(rules: DataFrame | Control, since_created: bool = False) -> Control:
    """Enabled rules with the condition unpacked, read once. With ``since_created`` a rule counts
    only events from its ``created_at`` on, so that a new rule starts with an empty window."""
    if isinstance(rules, Control):
        return rules
    c = F.col("condition")
    since = F.unix_millis("created_at") if since_created else F.lit(None).cast("bigint")
    return prepare_control(rules.filter("enabled").select(
        "rule_id",
        "name",
        "severity",
        (F.col("window_seconds").cast("bigint") * 1000).alias("window_ms"),
        (F.col("cooldown_seconds").cast("bigint") * 1000).alias("cooldown_ms"),
        since.alias("since_ms"),
        c["operator"].alias("operator"),
        c["value"].alias("value"),
        c["filters"]["event_type"].alias("f_type"),
        c["filters"]["source"].alias("f_source"),
    ))


def rule_matches(events: DataFrame, rules: DataFrame | Control, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per event and enabled rule whose filters it meets. Columns in ``keep`` stay."""
    slim = with_ms(events).select("event_id", "event_type", "source", "ts_ms", "seq", *keep)
    matched = match_filters(slim, rule_control(rules), ["rule_id", "window_ms", "since_ms"])
    return matched.where("since_ms IS NULL OR ts_ms >= since_ms").select(
        "rule_id", "window_ms", "event_id", "ts_ms", "seq", *keep
    )


def sliding_rule_counts(events: DataFrame, rules: DataFrame | Control, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per match, the rule's events in ``[ts - window, ts]`` so far, this one included.

    One window per rule over all sources.
    """
    return trailing_counts(rule_matches(events, rules), ["rule_id"], "window_ms", group_rows=group_rows)


def compare(count: Column, operator: Column, value: Column) -> Column:
    """The six comparisons; an unknown operator never holds."""
    return (
        F.when(operator == ">", count > value)
        .when(operator == ">=", count >= value)
        .when(operator == "<", count < value)
        .when(operator == "<=", count <= value)
        .when(operator == "==", count == value)
        .when(operator == "!=", count != value)
        .otherwise(F.lit(False))
    )


def threshold_candidates(
    events: DataFrame, rules: DataFrame | Control, group_rows: int = GROUP_ROWS, fresh: Column | None = None
) -> DataFrame:
    """Matches whose count meets the rule's condition, before cooldown.

    With ``fresh``, a condition on events, only those events can be candidates; the others count all the same.
    """
    control = rule_control(rules)
    # the windows of a rule that can't hold aren't counted
    able = replace(control, rows=control.rows.filter(F.col("operator").isin(*OPERATORS)))
    marked, keep = (events, ()) if fresh is None else (events.withColumn("_fresh", fresh), ("_fresh",))
    counts = trailing_counts(rule_matches(marked, able, keep), ["rule_id"], "window_ms", group_rows=group_rows)
    return (
        attach_control(
            counts if fresh is None else counts.filter("_fresh"), control, "rule_id",
            ["cooldown_ms", "operator", "value"],
        )
        .filter(compare(F.col("count"), F.col("operator"), F.col("value")))
        .select("rule_id", "cooldown_ms", "event_id", "ts_ms", "seq", "count")
    )


def threshold_fires(
    candidates: DataFrame,
    rules: DataFrame | Control,
    earlier: DataFrame | None = None,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Apply the cooldown and build anomaly rows.

    A rule that has not fired yet counts as having fired at time zero, so that a
    cooldown longer than the time since the epoch still suppresses.
    """
    fired = apply_cooldown(
        candidates,
        "rule_id",
        ["event_id", "count"],
        earlier=earlier,
        first_fire_ms=0,
        direct_rows=direct_rows,
    )
    return threshold_rows(fired, rules)


def threshold_rows(fired: DataFrame, rules: DataFrame | Control) -> DataFrame:
    """Anomaly rows of the candidates that fire."""
    control = rule_control(rules)
    message = F.concat(
        F.lit('Threshold rule "'), "name", F.lit('" triggered: count('), F.col("count").cast("string"),
        F.lit(") "), "operator", F.lit(" "), number_text(F.col("value")),
    )
    return attach_control(fired, control, "rule_id", ["name", "severity", "operator", "value"]).select(
        anomaly_id(F.col("rule_id"), F.col("event_id")).alias("anomaly_id"),
        "event_id",
        "rule_id",
        "severity",
        message.alias("message"),
        F.timestamp_millis("ts_ms").alias("detected_at"),
    )


def threshold_anomalies(events: DataFrame, rules: DataFrame | Control, group_rows: int = GROUP_ROWS) -> DataFrame:
    control = rule_control(rules)
    return threshold_fires(threshold_candidates(events, control, group_rows), control)

"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import iso_millis
from ..operators import builtin, ingest, listing, metrics, outbox, retention, rules, threshold, validate, zscore
from ..schemas import ANOMALIES, STREAM_ENTRY
from ..session import shared_folder
from ..sources import codec
from ..sources.tables import bind_events
from ..streaming import rollups, rule_changes, state
from ..streaming.pipeline import Pipeline, notify, read_log
from ..streaming.tables import OUTBOX, Layout, utc
from . import derived as d

Query = Callable[[SparkSession, str], DataFrame]


def present(df: DataFrame) -> DataFrame:
    """Times as ISO text, as the query interface returns them."""
    return df.select(*[
        iso_millis(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name)
        for f in df.schema
    ])


EVENT_COLUMNS = ["event_id", "event_type", "source", "timestamp", "payload", "metadata", "created_at"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind_events(spark, sf_dir)


def _day(n: int) -> datetime:
    return datetime(2024, 1, n, tzinfo=timezone.utc)


def stateless_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir)
    return builtin.run_pack(ev, {
        "invalid-payload": lambda e: builtin.invalid_payload(e, d.REQUIRED),
        "timestamp-drift": lambda e: builtin.timestamp_drift(e, d.AS_OF, d.DRIFT_SECONDS),
    })


def builtin_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = builtin.default_pack(d.AS_OF)
    pack["rate-spike"] = lambda e: builtin.rate_spike(e, d.RATE_MAX, d.RATE_SECONDS)
    pack["invalid-payload"] = lambda e: builtin.invalid_payload(e, d.REQUIRED)
    pack["timestamp-drift"] = lambda e: builtin.timestamp_drift(e, d.AS_OF, d.DRIFT_SECONDS)
    return builtin.run_pack(_events(spark, sf_dir), pack)


def _page(df: DataFrame) -> DataFrame:
    return present(df.select(*EVENT_COLUMNS))


def _metrics(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return metrics.window_metrics(
        _events(spark, sf_dir), d.AS_OF, d.MONTH_SECONDS, unlimited=True, **options
    )


def _recent_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = bind_events(spark, sf_dir, start=_day(10), end=_day(12))
    return listing.list_events(ev, limit=500, offset=20, start=_day(10), end=_day(12))


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = _day(30)
    start, _ = listing.dashboard_range("24h", as_of)
    return listing.live_feed(bind_events(spark, sf_dir, start=start), "24h", as_of)


def _flat_rules(df: DataFrame) -> DataFrame:
    c = F.col("condition")
    return present(df.select(
        "rule_id", "name", "enabled", "severity", "window_seconds", "cooldown_seconds",
        c["filters"]["event_type"].alias("f_type"), c["filters"]["source"].alias("f_source"),
        c["operator"].alias("operator"), c["value"].alias("value"), "created_at", "updated_at",
    ))


def _current_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rule_changes(d.rule_changes(spark, sf_dir))


def _issue_text(df: DataFrame) -> DataFrame:
    return df.withColumn("issues", F.array_join("issues", "; "))


def _checked_rules(df: DataFrame) -> DataFrame:
    c = F.col("condition")
    return _issue_text(df).select(
        "seq", "name", "enabled", "severity", "window_seconds", "cooldown_seconds",
        c["filters"]["event_type"].alias("f_type"), c["filters"]["source"].alias("f_source"),
        c["operator"].alias("operator"), c["value"].alias("value"), "issues",
    )


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.validate_events(d.event_requests(spark, sf_dir))
    return ingest.batch_gate(ingest.assign_event_id(checked))


# Parts of the events, of equal ranges of arrival numbers, in the order in which they are written to the log, by
# run of the stream; files per part, and rows of a file from which there are more.
IN_ORDER = (0, 1, 2, 3), (4, 5, 6, 7)
OUT_OF_ORDER = (1, 0, 2, 4, 3), (5, 7, 6)
PARTS, FILES, FILE_ROWS = 8, 4, 50_000
# Longer than a part that comes out of order lags.
SETTLE_SECONDS = 12 * 86400


def _parts(events: DataFrame) -> DataFrame:
    """Events with the part of the log they go to."""
    ends = events.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    lo, hi = ends.lo or 0, ends.hi or 0
    return events.withColumn("part", F.least(F.floor((F.col("seq") - lo) * PARTS / (hi - lo + 1)), F.lit(PARTS - 1)))


def _files(parts: DataFrame) -> int:
    """Files per part, the same for all: a part is a micro-batch."""
    largest = parts.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    return max(FILES, -(-largest // FILE_ROWS))


def _write_parts(parts: DataFrame, log: str, numbers: tuple[int, ...], files: int = FILES) -> None:
    for k in numbers:
        codec.write_log(parts.filter(F.col("part") == k).repartition(files), log)


def _run_pipeline(pipe: Pipeline, parts: DataFrame, root: str, order: tuple[tuple[int, ...], ...], **options) -> None:
    """Write and follow the log run by run, over one checkpoint, a part per micro-batch."""
    for numbers in order:
        _write_parts(parts, f"{root}/log", numbers)
        pipe.start(f"{root}/log", f"{root}/offsets", until_caught_up=True, files_per_batch=FILES, **options).awaitTermination()


def stream_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through the streaming pipeline: eight appends of the log, written out of
    order, one per micro-batch, in two runs over one checkpoint."""
    root = shared_folder(spark, "stream")
    pipe = Pipeline(
        spark, Layout(f"{root}/tables"), load_rules=lambda: d.rule_table(spark), profiles=d.profile_list(spark),
        settle_seconds=SETTLE_SECONDS,
    )
    _run_pipeline(pipe, _parts(_events(spark, sf_dir)), root, OUT_OF_ORDER)
    pipe.finish()
    return pipe.layout.anomalies.read(spark).select(*ANOMALIES.fieldNames())


def stream_anomalies_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resent copies evaluated as events of their own."""
    root = shared_folder(spark, "stream")
    pipe = Pipeline(
        spark, Layout(f"{root}/tables"), load_rules=lambda: d.rule_table(spark), profiles=d.profile_list(spark),
        settle_seconds=40 * 86400, evaluate_copies=True,
    )
    _run_pipeline(pipe, d.resent_parts(spark, sf_dir), root, IN_ORDER)
    pipe.finish()
    return pipe.layout.anomalies.read(spark).select(*ANOMALIES.fieldNames())


def _no_detectors(spark: SparkSession, root: str, **options) -> Pipeline:
    return Pipeline(
        spark, Layout(f"{root}/tables"), load_rules=lambda: d.rule_table(spark).limit(0),
        profiles=d.profile_list(spark).limit(0), **options)


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are sent again in later appends, stored once."""
    root = shared_folder(spark, "stream")
    pipe = _no_detectors(spark, root)
    _run_pipeline(pipe, d.resent_parts(spark, sf_dir), root, IN_ORDER)
    return pipe.layout.events.read(spark).select("event_id", "event_type", "source", "timestamp", "payload", "metadata", "seq")


def stream_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that starts behind what the log holds at its start."""
    root = shared_folder(spark, "stream")
    pipe, parts = _no_detectors(spark, root), _parts(_events(spark, sf_dir))
    _write_parts(parts, f"{root}/log", IN_ORDER[0])
    newest = spark.read.schema(STREAM_ENTRY).json(f"{root}/log").agg(F.max("_metadata.file_modification_time")).first()[0]
    start_at = utc(newest) + timedelta(milliseconds=1)
    _run_pipeline(pipe, parts, root, IN_ORDER[1:], start_at=start_at)
    return pipe.layout.events.read(spark).select("event_id", "seq")


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events come more than an hour behind the newest of earlier micro-batches."""
    root = shared_folder(spark, "stream")
    pipe = _no_detectors(spark, root)
    _run_pipeline(pipe, _parts(_events(spark, sf_dir)), root, OUT_OF_ORDER)
    late = pipe.layout.late.read(spark).select("event_id", F.lit(True).alias("late"))
    return pipe.layout.events.read(spark).join(late, "event_id", "left").select("event_id", F.coalesce("late", F.lit(False)).alias("late"))


def stream_rule_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules are read again for each micro-batch: some are there from the second run on."""
    root = shared_folder(spark, "stream")
    rules = d.rule_table(spark)
    layout, parts = Layout(f"{root}/tables"), _parts(_events(spark, sf_dir))
    for run, table in zip(IN_ORDER, (rules.filter(~F.col("rule_id").isin(*d.ADDED_RULES)), rules)):
        pipe = Pipeline(spark, layout, load_rules=lambda: table, profiles=d.profile_list(spark).limit(0))
        _run_pipeline(pipe, parts, root, (run,))
    return layout.anomalies.read(spark).select(*ANOMALIES.fieldNames())


def _run_stream(spark: SparkSession, parts: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stream of its own from the log to a table: in order, in two runs over one checkpoint."""
    root, files = shared_folder(spark, "stream"), _files(parts)
    for numbers in IN_ORDER:
        _write_parts(parts, f"{root}/log", numbers, files)
        entries = codec.decode_events(read_log(spark, f"{root}/log", files))
        _follow(make(entries.withColumn("timestamp", F.to_timestamp("timestamp"))), root)
    return spark.read.parquet(f"{root}/found")


def _follow(stream: DataFrame, root: str) -> None:
    writer = stream.writeStream.format("parquet").option("path", f"{root}/found").option("checkpointLocation", f"{root}/offsets")
    with state.rocksdb(stream.sparkSession):
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def stream_threshold_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold rules as state operators."""
    rules = threshold.rule_control(d.rule_table(spark))
    return _run_stream(spark, _parts(_events(spark, sf_dir)), lambda ev: state.threshold_stream(ev, rules))


def stream_zscore_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z-score profiles as state operators."""
    profiles = zscore.profile_control(d.profile_list(spark))
    return _run_stream(
        spark, _parts(_events(spark, sf_dir)), lambda ev: state.zscore_stream(ev, profiles, rule_id_prefix="stat").drop("details"))


def stream_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log folded by a stream, in order, in two runs over one checkpoint."""
    root = shared_folder(spark, "stream")
    changes = d.rule_changes(spark, sf_dir)
    parts = _parts(changes)
    for numbers in IN_ORDER:
        for k in numbers:
            parts.filter(F.col("part") == k).drop("part").repartition(FILES).write.mode("append").parquet(f"{root}/log")
        log = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", FILES).parquet(f"{root}/log")
        _follow(rule_changes.rule_states(log), root)
    return rule_changes.current_rules(spark.read.parquet(f"{root}/found"))


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_stream(spark, _parts(_events(spark, sf_dir)), rollups.minute_rollup)


def metrics_from_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.window_metrics(_rollup(spark, sf_dir), _events(spark, sf_dir), d.AS_OF, d.MONTH_SECONDS, unlimited=True)


def buckets_from_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.bucket_counts(_rollup(spark, sf_dir), _events(spark, sf_dir), _day(1) + timedelta(seconds=90), d.AS_OF, 10)


def stored_retention(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events and anomalies stored by day, cut on disk and read back."""
    layout = Layout(shared_folder(spark, "retention"))
    layout.events.append(_events(spark, sf_dir), 0)
    layout.anomalies.append(builtin.invalid_payload(_events(spark, sf_dir), d.REQUIRED), 0)
    as_of = d.AS_OF - timedelta(hours=10)
    retention.drop_expired_days(spark, layout.events.path, as_of, 15)
    retention.drop_expired_days(spark, layout.anomalies.path, as_of, 20, "detected_at")
    return layout.events.read(spark), layout.anomalies.read(spark).select(*ANOMALIES.fieldNames())


def stream_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored anomalies followed by the notification stream, appended in two batches."""
    root = shared_folder(spark, "stream")
    layout = Layout(f"{root}/tables")
    layout.create(spark)
    found = stateless_anomalies(spark, sf_dir)
    for batch, rule in enumerate(("invalid-payload", "timestamp-drift")):
        layout.anomalies.append_new(found.filter(F.col("rule_id") == rule), batch)
        notify(spark, layout, f"{root}/offsets", d.CHANNELS, until_caught_up=True).awaitTermination()
    return layout.outbox.read(spark).select(*OUTBOX.fieldNames())


def _bounded_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule_control = threshold.rule_control(d.rule_table(spark))
    found = threshold.threshold_candidates(_events(spark, sf_dir), rule_control, group_rows=0)
    return threshold.threshold_fires(found, rule_control, direct_rows=0)


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}

    # sources and sinks
    q["scan_events"] = lambda s, p: _page(_events(s, p))
    q["encode_events"] = lambda s, p: codec.encode_events(_events(s, p))
    q["decode_events"] = lambda s, p: codec.decode_events(d.stream_entries(s, p))
    q["dedup_events"] = lambda s, p: present(ingest.dedup_events(d.resent_events(s, p)))
    q["retention_events"] = lambda s, p: _page(retention.retain_events(_events(s, p), d.AS_OF, 15))
    q["retention_anomalies"] = lambda s, p: present(
        retention.retain_anomalies(stateless_anomalies(s, p), d.AS_OF, 20)
    )

    # validation and batches
    q["validate_events"] = lambda s, p: _issue_text(
        validate.validate_events(d.event_requests(s, p))
    ).drop("body", "batch_id")
    q["assign_event_id"] = lambda s, p: ingest.assign_event_id(
        validate.validate_events(d.event_requests(s, p)).filter(F.size("issues") == 0)
    ).select("seq", "event_id")
    q["batch_gate"] = lambda s, p: _gated(s, p).select("batch_id", "seq", "batch_accepted", "batch_size")
    q["batch_receipt"] = lambda s, p: ingest.batch_receipt(_gated(s, p))
    q["validate_rules_create"] = lambda s, p: _checked_rules(
        validate.validate_rules_create(d.bodies(s, p, d.RULE_BODY))
    )
    q["validate_rules_replace"] = lambda s, p: _checked_rules(
        validate.validate_rules_replace(d.bodies(s, p, d.RULE_BODY))
    )
    q["validate_rules_patch"] = lambda s, p: _checked_rules(
        validate.validate_rules_patch(d.bodies(s, p, d.PATCH_BODY))
    )
    q["validate_profiles"] = lambda s, p: _issue_text(
        validate.validate_profiles(d.profile_table(s, p))
    ).select("seq", "id", "issues")
    q["valid_notifications"] = lambda s, p: validate.valid_notifications(
        d.bodies(s, p, d.NOTIFICATION_BODY, "message")
    )

    # lists and lookups
    q["list_events"] = lambda s, p: _page(listing.list_events(_events(s, p), 500, 100))
    q["list_events_filtered"] = lambda s, p: _page(
        listing.list_events(bind_events(s, p, source="user-7"), 500, event_type="error", source="user-7")
    )
    q["list_events_range"] = lambda s, p: _page(_recent_range(s, p))
    q["get_event"] = lambda s, p: _page(listing.get_event(bind_events(s, p, event_id="424"), "424"))
    q["list_anomalies"] = lambda s, p: present(
        listing.list_anomalies(stateless_anomalies(s, p), 200, 10, rule_id="invalid-payload", severity="medium")
    )
    q["events_page_info"] = lambda s, p: listing.page_info(
        listing.list_events(_events(s, p), 9999, 3, event_type="error"), 9999, 3
    )
    q["feed_last_24h"] = lambda s, p: _page(_feed(s, p))
    q["anomaly_timeline"] = lambda s, p: present(listing.anomaly_timeline(stateless_anomalies(s, p), "low"))
    q["anomaly_drilldown"] = lambda s, p: present(
        listing.anomaly_drilldown(stateless_anomalies(s, p), retention.retain_events(_events(s, p), d.AS_OF, 20))
    )

    # metrics
    q["metrics_by_type"] = lambda s, p: _metrics(s, p)
    q["metrics_by_source"] = lambda s, p: _metrics(s, p, group_by="source", event_type="error")
    q["error_rate"] = lambda s, p: metrics.error_rate(_metrics(s, p))
    q["top_events"] = lambda s, p: metrics.top_events(_metrics(s, p, group_by="source"))
    q["throughput"] = lambda s, p: metrics.throughput(_metrics(s, p))
    q["bucket_counts"] = lambda s, p: metrics.bucket_counts(_events(s, p), 600)

    # rule table
    q["apply_rule_changes"] = lambda s, p: _flat_rules(_current_rules(s, p))
    q["rules_all"] = lambda s, p: _current_rules(s, p).select("rule_id", "name", "enabled", "severity")
    q["rules_enabled"] = lambda s, p: rules.enabled_rules(_current_rules(s, p)).select("rule_id", "name")

    q["get_rule"] = lambda s, p: rules.get_rule(_current_rules(s, p), d.RULE_ID).select("rule_id", "name", "severity")
    q["change_messages"] = lambda s, p: rules.change_messages(d.rule_changes(s, p))

    # threshold rules
    q["rule_matches"] = lambda s, p: threshold.rule_matches(_events(s, p), d.rule_table(s)).select(
        "rule_id", "event_id"
    )
    q["sliding_rule_counts"] = lambda s, p: threshold.sliding_rule_counts(_events(s, p), d.rule_table(s)).select(
        "rule_id", "event_id", "count"
    )
    # the forms for groups too large for a task, and for chains of very many candidates
    q["sliding_rule_counts_bounded"] = lambda s, p: threshold.sliding_rule_counts(
        _events(s, p), d.rule_table(s), group_rows=0
    ).select("rule_id", "event_id", "count")
    q["sliding_rule_counts_since"] = lambda s, p: threshold.sliding_rule_counts(
        _events(s, p), threshold.rule_control(d.rule_table(s).withColumn("created_at", F.lit(_day(10))), since_created=True)
    ).select("rule_id", "event_id", "count")
    q["threshold_anomalies_bounded"] = lambda s, p: present(_bounded_fires(s, p))
    q["threshold_candidates"] = lambda s, p: threshold.threshold_candidates(
        _events(s, p), d.rule_table(s)
    ).select("rule_id", "event_id", "count")
    q["threshold_anomalies"] = lambda s, p: present(
        threshold.threshold_anomalies(_events(s, p), d.rule_table(s))
    )

    # z-score
    q["zscore_baseline"] = lambda s, p: zscore.zscore_baseline(_events(s, p), d.profile_list(s)).select(
        "profile_id", "bucket", "count", "mean", "stddev"
    )
    q["zscore_candidates"] = lambda s, p: zscore.zscore_candidates(_events(s, p), d.profile_list(s)).select(
        "profile_id", "event_id", "current", "mean", "stddev", "z"
    )
    q["zscore_anomalies"] = lambda s, p: present(
        zscore.zscore_anomalies(_events(s, p), d.profile_list(s), rule_id_prefix="stat").drop("details")
    )

    q["zscore_details"] = lambda s, p: zscore.zscore_anomalies(_events(s, p), d.profile_list(s)).select(
        "event_id", *[f"details.{c}" for c in (
            "profile_id", "bucket_start", "bucket_seconds", "current_count", "baseline_buckets", "mean", "stddev", "z")],
        F.col("details.filters.event_type").alias("f_type"), F.col("details.filters.source").alias("f_source"),
    )

    # built-in detectors
    q["rate_spike"] = lambda s, p: present(builtin.rate_spike(_events(s, p), d.RATE_MAX, d.RATE_SECONDS))
    q["invalid_payload"] = lambda s, p: present(builtin.invalid_payload(_events(s, p), d.REQUIRED))
    q["timestamp_drift"] = lambda s, p: present(builtin.timestamp_drift(
        d.events_with_k(s, p).withColumn("raw", F.expr(d.ENTRY_FIELDS["timestamp"])).fillna({"raw": "not-a-date"}),
        d.AS_OF, d.DRIFT_SECONDS, raw="raw",
    ))
    q["builtin_anomalies"] = lambda s, p: present(builtin_pack(s, p))

    q["default_pack"] = lambda s, p: present(builtin.run_pack(_events(s, p), builtin.default_pack(d.AS_OF)))

    # the pipeline
    q["stream_anomalies"] = lambda s, p: present(stream_anomalies(s, p))
    q["stream_anomalies_with_copies"] = lambda s, p: present(stream_anomalies_with_copies(s, p))
    q["stream_dedup"] = lambda s, p: present(stream_dedup(s, p))
    q["stream_new_only"] = stream_new_only
    q["stream_late"] = stream_late
    q["stream_rule_added"] = lambda s, p: present(stream_rule_added(s, p))
    q["stream_threshold_state"] = lambda s, p: present(stream_threshold_state(s, p))
    q["stream_zscore_state"] = lambda s, p: present(stream_zscore_state(s, p))

    # notifications
    q["notification_message"] = lambda s, p: outbox.notification_message(stateless_anomalies(s, p))
    q["stream_notifications"] = stream_notifications
    q["stream_rule_table"] = lambda s, p: _flat_rules(stream_rule_table(s, p))
    q["metrics_from_rollup"] = metrics_from_rollup
    q["buckets_from_rollup"] = buckets_from_rollup
    q["retention_stored_events"] = lambda s, p: _page(stored_retention(s, p)[0])
    q["retention_stored_anomalies"] = lambda s, p: present(stored_retention(s, p)[1])
    q["zscore_baseline_wide"] = lambda s, p: zscore.zscore_baseline(
        d.dense_events(s, p), d.profile_list(s, d.DENSE_PROFILES)
    ).select("profile_id", "bucket", "count", "mean", "stddev")
    q["zscore_anomalies_wide"] = lambda s, p: present(zscore.zscore_anomalies(
        d.dense_events(s, p), d.profile_list(s, d.DENSE_PROFILES), rule_id_prefix="stat").drop("details"))
    q["zscore_default_profile"] = lambda s, p: present(zscore.zscore_anomalies(
        d.dense_events(s, p), zscore.default_profiles(s)).drop("details"))
    q["notification_outbox"] = lambda s, p: outbox.notification_outbox(stateless_anomalies(s, p), d.CHANNELS)
    return q

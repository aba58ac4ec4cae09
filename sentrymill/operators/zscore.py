"""Z-score spikes over counts in fixed time buckets.

Means and deviations are left folds over the baseline counts, oldest first, in
plain double arithmetic: results at the exact threshold depend on that order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import anomaly_id, iso_from_ms, number_text, round4
from ..schemas import PROFILES
from ..session import checkpointed
from ..sources.tables import with_ms
from .cooldown import DIRECT_ROWS, apply_cooldown
from .joins import Control, attach_control, match_filters, prepare_control, sized_join
from .ranking import GROUP_ROWS, running_counts
from .validate import validate_profiles

# The profile used where none is given.
DEFAULT_PROFILE = {
    "id": "zscore-count-spike",
    "bucket_seconds": 10.0,
    "baseline_buckets": 5.0,
    "z_threshold": 2.0,
    "cooldown_seconds": 30.0,
    "filters": None,
}
DEFAULT_SEVERITY = "warning"

# Buckets per block when baselines are looked up; never fewer than a baseline needs.
BLOCK_BUCKETS = 1024
# Baselines of more buckets are counted apart.
WIDE_BUCKETS = 64


def default_profiles(spark: SparkSession) -> DataFrame:
    """The profile used where none is given, as a table."""
    return spark.createDataFrame([tuple(DEFAULT_PROFILE[f] for f in PROFILES.fieldNames())], PROFILES)


def profile_control(profiles: DataFrame | Control) -> Control:
    """Profiles that pass validation, in milliseconds, read once."""
    if isinstance(profiles, Control):
        return profiles
    return prepare_control(validate_profiles(profiles).filter(F.size("issues") == 0).select(
        F.col("id").alias("profile_id"),
        F.round(F.col("bucket_seconds") * 1000).cast("bigint").alias("bucket_ms"),
        F.col("baseline_buckets").cast("int").alias("n_buckets"),
        "z_threshold",
        F.round(F.coalesce("cooldown_seconds", F.lit(0.0)) * 1000).cast("bigint").alias("cooldown_ms"),
        F.col("filters.event_type").alias("f_type"),
        F.col("filters.source").alias("f_source"),
    ))


def profile_matches(events: DataFrame, profiles: DataFrame | Control, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per event and profile it counts for, with the bucket number. Columns in ``keep`` stay."""
    slim = with_ms(events).select("event_id", "event_type", "source", "ts_ms", "seq", *keep)
    return match_filters(slim, profile_control(profiles), ["profile_id", "bucket_ms"]).select(
        "profile_id",
        F.floor(F.col("ts_ms") / F.col("bucket_ms")).alias("bucket"),
        "event_id",
        "ts_ms",
        "seq",
        *keep,
    )


def zscore_baseline(events: DataFrame, profiles: DataFrame | Control, hot: bool = False) -> DataFrame:
    """Per profile and bucket with enough history: its count, and mean and population
    deviation of the N latest non-empty earlier buckets no older than N + 1 buckets.

    Profiles of many buckets are counted apart, so that the widest doesn't set the cost of the others.
    With ``hot`` buckets whose count is clearly below the threshold may be absent.
    """
    control = profile_control(profiles)
    counts = profile_matches(events, control).groupBy("profile_id", "bucket").agg(F.count("*").alias("count"))
    rows = attach_control(counts, control, "profile_id", ["n_buckets", "bucket_ms", "z_threshold"])
    wide = F.col("n_buckets") > WIDE_BUCKETS
    widths = control.rows.agg(F.max(F.when(~wide, F.col("n_buckets"))).alias("narrow"), F.count_if(wide).alias("wide")).first()
    if not widths.wide:
        return _narrow_baseline(rows, widths.narrow or 2)
    if widths.narrow is None:
        return _wide_baseline(rows, hot)
    rows = checkpointed(rows)
    return _narrow_baseline(rows.filter(~wide), widths.narrow).unionByName(_wide_baseline(rows.filter(wide), hot))


def _with_tails(rows: DataFrame, block: Column, reach: Column) -> DataFrame:
    """Blocks of buckets (``_blk``), each preceded by a copy of the tail of the one before; ``_own`` is a row's own block."""
    blk = F.floor(F.col("bucket") / block)
    in_tail = F.pmod(F.col("bucket"), block) >= block - reach
    return rows.withColumn("_own", blk).withColumn(
        "_blk", F.explode(F.when(in_tail, F.array(blk, blk + 1)).otherwise(F.array(blk)))
    )


def _narrow_baseline(rows: DataFrame, widest: int) -> DataFrame:
    """By a list of the ``widest`` buckets before each."""
    spread = _with_tails(rows, F.lit(max(BLOCK_BUCKETS, widest + 1)), F.lit(widest + 1))
    before = Window.partitionBy("profile_id", "_blk").orderBy("bucket").rowsBetween(-widest, -1)
    recent = F.collect_list(F.struct("bucket", "count")).over(before)
    oldest = F.col("bucket") - F.col("n_buckets") - 1
    usable = F.filter("_recent", lambda b: b["bucket"] >= F.col("_oldest"))
    picked = spread.withColumn("_recent", recent).filter(F.col("_blk") == F.col("_own")).withColumn(
        "_oldest", oldest
    ).withColumn("_usable", usable).filter(F.size("_usable") >= F.col("n_buckets"))
    n = F.col("n_buckets")
    base = F.transform(F.slice("_usable", -n, n), lambda b: b["count"].cast("double"))
    mean = F.aggregate("_base", F.lit(0.0), lambda acc, x: acc + x) / n
    spread_sum = F.aggregate(
        "_base", F.lit(0.0), lambda acc, x: acc + (x - F.col("mean")) * (x - F.col("mean"))
    )
    return (
        picked.withColumn("_base", base)
        .withColumn("mean", mean)
        .withColumn("stddev", F.sqrt(spread_sum / n))
        .select("profile_id", "bucket", "bucket_ms", "count", "mean", "stddev")
    )


def may_reach(values: np.ndarray, at: np.ndarray, n: int, mean: np.ndarray, z: float) -> np.ndarray:
    """Whether ``values[at]`` can be ``z`` deviations of the ``n`` values before above their mean.

    Sums of whole numbers give the variance without a walk over each baseline. It is lowered by more
    than both its own error and that of the fold, so no value at the threshold is missed.
    """
    centred = values - np.floor(np.median(values))
    if z <= 0 or np.square(centred).sum() >= 2.0 ** 53:
        return np.ones(len(at), bool)
    first, second = (np.concatenate(([0.0], np.cumsum(x))) for x in (centred, centred * centred))
    square = (second[at] - second[at - n]) / n
    variance = square - ((first[at] - first[at - n]) / n) ** 2
    slack = (n + 64) * np.finfo("float64").eps * 4
    low = np.sqrt(np.maximum(variance - slack * square, 0))
    return values[at] - mean >= z * low * (1 - 1e-9) - slack * np.abs(mean)


def _wide_baseline(rows: DataFrame, hot: bool = False) -> DataFrame:
    """By blocks as wide as a profile's own baseline, each walked by one task that holds its counts
    and those of the block before."""
    reach = F.col("n_buckets") + 1
    spread = _with_tails(rows, reach, reach)

    def walk_block(block: pa.Table) -> pa.Table:
        order = np.argsort(block.column("bucket").to_numpy())
        bucket, count = (block.column(c).to_numpy()[order] for c in ("bucket", "count"))
        n = block.column("n_buckets")[0].as_py()
        own = np.flatnonzero((block.column("_own").to_numpy() == block.column("_blk").to_numpy())[order])
        # N buckets before it, the first of them no older than N + 1 buckets
        ready = own[own >= n]
        ready = ready[bucket[ready - n] >= bucket[ready] - n - 1]
        values = count.astype("float64")
        total = np.concatenate(([0.0], np.cumsum(values)))
        if total[-1] < 2.0 ** 53:  # whole numbers: exact in any order
            mean = (total[ready] - total[ready - n]) / n
        else:
            mean = np.array([np.cumsum(values[at - n:at])[-1] / n for at in ready.tolist()])
        if hot:
            kept = may_reach(values, ready, n, mean, block.column("z_threshold")[0].as_py())
            ready, mean = ready[kept], mean[kept]
        stddev, gap = np.zeros(len(ready)), np.zeros(n)
        for k, at in enumerate(ready.tolist()):
            np.subtract(values[at - n:at], mean[k], out=gap)
            np.multiply(gap, gap, out=gap)
            stddev[k] = np.sqrt(np.cumsum(gap, out=gap)[-1] / n)
        return pa.table({
            "profile_id": pa.repeat(block.column("profile_id")[0], len(ready)), "bucket": bucket[ready],
            "bucket_ms": pa.repeat(block.column("bucket_ms")[0], len(ready)), "count": count[ready], "mean": mean, "stddev": stddev})

    return spread.groupBy("profile_id", "_blk").applyInArrow(
        walk_block, "profile_id string, bucket bigint, bucket_ms bigint, count bigint, mean double, stddev double")


def zscore(count: Column) -> Column:
    return (count - F.col("mean")) / F.col("stddev")


def zscore_candidates(
    events: DataFrame, profiles: DataFrame | Control, group_rows: int = GROUP_ROWS, fresh: Column | None = None
) -> DataFrame:
    """Events at which their bucket's running count reaches the threshold.

    The score grows with the count, so only buckets whose full count reaches the
    threshold can hold such events; events of all others drop out before ranking.
    With ``fresh``, a condition on events, only those events can be candidates; the others count all the same.
    """
    control = profile_control(profiles)
    scored = attach_control(
        zscore_baseline(events, control, hot=True).filter("stddev > 0"), control, "profile_id", ["z_threshold", "cooldown_ms"]
    )
    hot = checkpointed(scored.filter(zscore(F.col("count")) >= F.col("z_threshold")))
    size = hot.agg(F.count("*").alias("rows"), F.coalesce(F.max("count"), F.lit(0)).alias("largest")).first()
    if not size.rows:
        events = events.where("false")
    marked, keep = (events, ()) if fresh is None else (events.withColumn("_fresh", fresh), ("_fresh",))
    rows = sized_join(
        profile_matches(marked, control, keep), hot.drop("count"), ["profile_id", "bucket"], size.rows
    )
    ranked = running_counts(rows, ["profile_id", "bucket"], size.largest, "current", group_rows)
    return (
        (ranked if fresh is None else ranked.filter("_fresh"))
        .withColumn("z", zscore(F.col("current")))
        .filter(F.col("z") >= F.col("z_threshold"))
        .select(
            "profile_id", "cooldown_ms", "event_id", "ts_ms", "seq", "current", "mean", "stddev", "z",
            (F.col("bucket") * F.col("bucket_ms")).alias("bucket_start_ms"),
        )
    )


def zscore_fires(
    candidates: DataFrame,
    profiles: DataFrame | Control,
    severity: str = DEFAULT_SEVERITY,
    rule_id_prefix: str = "",
    earlier: DataFrame | None = None,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Apply the cooldown per profile and build anomaly rows with a details struct.
    A profile that has not fired yet fires at once."""
    fired = apply_cooldown(
        candidates,
        "profile_id",
        ["event_id", "current", "mean", "stddev", "z", "bucket_start_ms"],
        earlier=earlier,
        direct_rows=direct_rows,
    )
    return zscore_rows(fired, profiles, severity, rule_id_prefix)


def zscore_rows(
    fired: DataFrame, profiles: DataFrame | Control, severity: str = DEFAULT_SEVERITY, rule_id_prefix: str = ""
) -> DataFrame:
    """Anomaly rows, with a details struct, of the candidates that fire."""
    rows = attach_control(
        fired, profile_control(profiles), "profile_id", ["bucket_ms", "n_buckets", "f_type", "f_source"]
    )
    details = F.struct(
        F.col("profile_id"),
        iso_from_ms(F.col("bucket_start_ms")).alias("bucket_start"),
        (F.col("bucket_ms") / 1000).alias("bucket_seconds"),
        F.col("current").alias("current_count"),
        F.col("n_buckets").alias("baseline_buckets"),
        round4(F.col("mean")).alias("mean"),
        round4(F.col("stddev")).alias("stddev"),
        round4(F.col("z")).alias("z"),
        F.struct(F.col("f_type").alias("event_type"), F.col("f_source").alias("source")).alias("filters"),
    )
    parts = F.concat_ws(
        ", ",
        F.when(F.col("f_type") != "", F.concat(F.lit("event_type="), "f_type")),
        F.when(F.col("f_source") != "", F.concat(F.lit("source="), "f_source")),
    )
    d = F.col("details")
    message = F.concat(
        F.lit("Z-score spike detected"),
        F.when(parts != "", F.concat(F.lit(" ("), parts, F.lit(")"))).otherwise(F.lit("")),
        F.lit(": z="), number_text(d["z"]),
        F.lit(", current="), d["current_count"].cast("string"),
        F.lit(", mean="), number_text(d["mean"]),
        F.lit(", stddev="), number_text(d["stddev"]),
        F.lit(", bucketSeconds="), number_text(d["bucket_seconds"]),
        F.lit(", bucketStart="), d["bucket_start"],
    )
    rule_id = F.concat(F.lit(f"{rule_id_prefix}-" if rule_id_prefix else ""), F.col("profile_id"))
    return (
        rows.withColumn("details", details)
        .withColumn("rule_id", rule_id)
        .select(
            anomaly_id(F.col("rule_id"), F.col("event_id")).alias("anomaly_id"),
            "event_id",
            "rule_id",
            F.lit(severity).alias("severity"),
            message.alias("message"),
            F.timestamp_millis("ts_ms").alias("detected_at"),
            "details",
        )
    )


def zscore_anomalies(events: DataFrame, profiles: DataFrame | Control, **options) -> DataFrame:
    control = profile_control(profiles)
    return zscore_fires(zscore_candidates(events, control), control, **options)

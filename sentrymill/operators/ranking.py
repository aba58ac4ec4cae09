"""Counting rows up to and including each row, in arrival order.

Order is ``(ts_ms, seq)``; ``seq`` is a unique bigint. Both counts below are
exact for ties and have two ways of running: one shuffle of the rows where all
groups are of moderate size, and a form that bounds every task where some group
is large. The size of the largest group, read first, decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .joins import join_same, seq_run

# Rows one window partition may hold before the bounded form is used.
GROUP_ROWS = 2_000_000
# Time slice of the bounded form: at most this many distinct milliseconds each.
SLICE_MS = 600_000


def trailing_counts(
    rows: DataFrame,
    keys: list[str],
    lookback: str,
    out: str = "count",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Rows of the same group in ``[ts_ms - lookback, ts_ms]`` that are not later
    than the row itself. ``lookback`` names a column of milliseconds that is fixed
    within a group. The lower edge is inclusive."""
    group = [*keys, lookback]
    blocks = rows.groupBy(*group, F.floor(F.col("ts_ms") / F.col(lookback)).alias("_blk")).agg(
        F.count("*").alias("_n")
    )
    # A window partition holds a block and a copy of the one before it.
    largest = blocks.agg(F.max("_n")).first()[0] or 0
    if 2 * largest <= group_rows:
        return _halo_counts(rows, group, lookback, out)
    return _curve_counts(rows, group, lookback, out)


def running_counts(
    rows: DataFrame, keys: list[str], largest: int, out: str = "count", group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Rank of each row within its group. ``largest`` bounds the rows of a group."""
    if largest <= group_rows:
        w = Window.partitionBy(*keys).orderBy("ts_ms", "seq")
        return rows.withColumn(out, F.row_number().over(w).cast("bigint"))
    return _curve_counts(rows, keys, None, out)


def _halo_counts(rows: DataFrame, group: list[str], lookback: str, out: str) -> DataFrame:
    """Blocks one lookback wide, each with a copy of the block before it.

    A row at offset p of its block looks back to offset p of the block before. So
    its count is its rank in its own block plus the earlier block's rows at offset
    p or later. Both come from running sums over the two blocks merged by offset,
    an own row ahead of copies at the same offset. No frame depends on the
    lookback, so groups with different lookbacks share one pass.
    """
    span = F.col(lookback)
    blk = F.floor(F.col("ts_ms") / span)
    copies = F.array(
        F.struct(blk.alias("blk"), F.lit(0).alias("early")),
        F.struct((blk + 1).alias("blk"), F.lit(1).alias("early")),
    )
    spread = (
        rows.withColumn("_off", F.col("ts_ms") - blk * span)
        .withColumn("_c", F.explode(copies))
        .select(*rows.columns, "_off", F.col("_c.blk").alias("_blk"), F.col("_c.early").alias("_early"))
    )
    block = Window.partitionBy(*group, "_blk")
    merged = block.orderBy("_off", "_early", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return (
        spread.withColumn("_own_n", F.sum(1 - F.col("_early")).over(merged))
        .withColumn("_gone_n", F.sum("_early").over(merged))
        .withColumn("_early_n", F.sum("_early").over(block))
        .filter(F.col("_early") == 0)
        .withColumn(out, F.col("_own_n") + F.col("_early_n") - F.col("_gone_n"))
        .drop("_off", "_blk", "_early", "_own_n", "_gone_n", "_early_n")
    )


def _curve_counts(rows: DataFrame, group: list[str], lookback: str | None, out: str) -> DataFrame:
    """The same counts where a group or block is too large for one task.

    Rows first collapse to counts per group, millisecond and run of seq values,
    with partial sums before the shuffle. The cumulative curve over milliseconds
    is built per time slice plus a prefix over slice totals, and read at each
    occupied millisecond and at that millisecond minus the lookback. Rows then
    meet the curve on (group, millisecond, run), at most a run's length of rows per key.
    """
    cell_keys = [*group, "ts_ms", "_run"]
    in_ms = Window.partitionBy(*group, "ts_ms").orderBy("_run").rowsBetween(Window.unboundedPreceding, 0)
    cells = (
        rows.groupBy(*group, "ts_ms", seq_run().alias("_run"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(in_ms) - F.col("_n"))
    )
    per_ms = cells.groupBy(*group, "ts_ms").agg(F.sum("_n").alias("_n"))

    readings = [F.struct(F.col("ts_ms").alias("at"), F.col("_n").alias("n"), F.lit(1).alias("sign"))]
    if lookback is not None:
        readings.append(
            F.struct(
                (F.col("ts_ms") - F.col(lookback)).alias("at"),
                F.lit(0).cast("bigint").alias("n"),
                F.lit(-1).alias("sign"),
            )
        )
    marks = per_ms.withColumn("_r", F.explode(F.array(*readings))).select(
        *group,
        F.col("ts_ms").alias("_ms"),
        F.col("_r.at").alias("_at"),
        F.col("_r.n").alias("_n"),
        F.col("_r.sign").alias("_sign"),
        F.floor(F.col("_r.at") / F.lit(SLICE_MS)).alias("_slice"),
    )
    # Readings sort before the occupied millisecond itself: counts are of earlier rows.
    in_slice = Window.partitionBy(*group, "_slice").orderBy("_at", "_sign")
    over_slices = Window.partitionBy(*group).orderBy("_slice")
    prefix = (
        marks.groupBy(*group, "_slice")
        .agg(F.sum("_n").alias("_total"))
        .withColumn(
            "_prefix",
            F.sum("_total").over(over_slices.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_total"),
        )
        .drop("_total")
    )
    base = (
        join_same(
            marks.withColumn(
                "_inside",
                F.sum("_n").over(in_slice.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"),
            ),
            prefix, [*group, "_slice"],
        )
        .groupBy(*group, F.col("_ms").alias("ts_ms"))
        .agg(F.sum(F.col("_sign") * (F.col("_prefix") + F.col("_inside"))).alias("_base"))
    )
    curve = join_same(cells, base, [*group, "ts_ms"]).select(
        *cell_keys, (F.col("_base") + F.col("_before")).alias("_base")
    )
    in_cell = Window.partitionBy(*cell_keys).orderBy("seq")
    return (
        join_same(rows.withColumn("_run", seq_run()).withColumn("_rn", F.row_number().over(in_cell)), curve, cell_keys)
        .withColumn(out, F.col("_base") + F.col("_rn"))
        .select(*rows.columns, out)
    )

"""Ingest: ids, atomic batches, receipts, idempotent storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import uuid_text
from ..session import checkpointed
from .joins import join_same, seq_run, with_group_values


def assign_event_id(events: DataFrame) -> DataFrame:
    """Fill an absent id with one fixed by arrival number and content, so that a
    retried task assigns the same id again."""
    content = F.concat_ws("\x1f", F.col("seq").cast("string"), "event_type", "source", "timestamp", "payload")
    return events.withColumn("event_id", F.coalesce("event_id", uuid_text(F.md5(content))))


def dedup_events(events: DataFrame) -> DataFrame:
    """One row per event id, the first to arrive.

    An aggregate rather than a window: copies of an id collapse before the shuffle,
    so an id sent very often costs one row per input split.
    """
    rest = [c for c in events.columns if c not in ("event_id", "seq")]
    first = F.min(F.struct("seq", *rest)).alias("_first")
    return events.groupBy("event_id").agg(first).select("event_id", "_first.*").select(*events.columns)


def new_events(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``batch`` to insert: first per id and not in ``stored`` yet."""
    return dedup_events(batch).join(stored.select("event_id"), "event_id", "left_anti")


def batch_gate(validated: DataFrame) -> DataFrame:
    """Reject a batch as a whole when any of its events has issues.

    Adds ``batch_accepted`` and ``batch_size`` to each row. A very large batch is
    neither collected nor sent to one task: its verdict is folded from runs of
    arrival numbers. The checked rows are written once, since both the verdict and
    the join read them.
    """
    return with_group_values(
        checkpointed(validated),
        "batch_id",
        {"batch_accepted": F.bool_and(F.size("issues") == 0), "batch_size": F.count("*")},
        {"batch_accepted": F.bool_and, "batch_size": F.sum},
    )


def batch_receipt(gated: DataFrame) -> DataFrame:
    """The answer to each batch, in rows: an accepted batch lists its ids with their
    input position from 0; a rejected one lists the events at fault and their issues.

    The position is a rank within a run of seq values plus the sizes of the runs
    before it, so the ids of a batch are never gathered in one place.
    """
    gated = checkpointed(gated.select("batch_id", "seq", "event_id", "issues", "batch_accepted", "batch_size"))
    accepted = gated.filter("batch_accepted").withColumn("_run", seq_run())
    before = Window.partitionBy("batch_id").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        accepted.groupBy("batch_id", "_run")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    in_run = Window.partitionBy("batch_id", "_run").orderBy("seq")
    listed = (
        accepted.withColumn("_rn", F.row_number().over(in_run))
        .transform(lambda rows: join_same(rows, runs, ["batch_id", "_run"]))
        .select(
            "batch_id",
            F.lit("accepted").alias("status"),
            F.col("batch_size").alias("count"),
            (F.col("_before") + F.col("_rn") - 1).cast("bigint").alias("position"),
            "event_id",
            F.lit(None).cast("string").alias("issue"),
        )
    )
    refused = gated.filter(~F.col("batch_accepted") & (F.size("issues") > 0)).select(
        "batch_id",
        F.lit("rejected").alias("status"),
        F.col("batch_size").alias("count"),
        F.lit(None).cast("bigint").alias("position"),
        "event_id",
        F.array_join("issues", "; ").alias("issue"),
    )
    return listed.unionByName(refused)

"""Equi-joins that hold up when one key carries a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import checkpointed

# A control table up to this many rows of ``ROW_BYTES`` as text is broadcast, so that the
# broadcast stays in the tens of megabytes; longer rows count as several.
BROADCAST_ROWS = 20_000
ROW_BYTES = 400

# A hot key is dealt over at least so many partitions, and over a third of all where the copies of the small
# side that this takes stay within a bound.
SALTS = 16
COPIED_ROWS = 50_000_000

# Consecutive values of the unique arrival number that may share a join key.
SEQ_RUN = 1 << 20


def seq_run() -> Column:
    """The run of arrival numbers a row belongs to; rows without one are a run of their own."""
    return F.coalesce(F.floor(F.col("seq") / F.lit(SEQ_RUN)), F.lit(-(1 << 62)))


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys come from ``left``."""
    renamed = right.select(*[F.col(c).alias(f"_same_{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in keys])
    return left.join(renamed, on, how).drop(*[f"_same_{c}" for c in keys])


def with_group_values(rows: DataFrame, key: str, partial: dict[str, Column], total: dict[str, Callable]) -> DataFrame:
    """Add values of a whole group to each of its rows, whatever the group's size.

    ``partial`` aggregates each run of a group, before the shuffle where possible;
    ``total`` folds the runs of a group, by the same names. Rows then join on group
    and run, so no join key has more rows than a run is long.
    """
    whole = Window.partitionBy(key)
    runs = rows.groupBy(key, seq_run().alias("_run")).agg(*[agg.alias(name) for name, agg in partial.items()])
    values = runs.select(key, "_run", *[fold(F.col(name)).over(whole).alias(name) for name, fold in total.items()])
    return join_same(rows.withColumn("_run", seq_run()), values, [key, "_run"]).drop("_run")


def salts_for(spark: SparkSession, rows: int) -> int:
    """Partitions that a key is dealt over when the side of ``rows`` rows is copied to each."""
    third = int(spark.conf.get("spark.sql.shuffle.partitions")) // 3
    return max(SALTS, min(third, COPIED_ROWS // max(1, rows)))


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    salt_by: str = "seq",
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join where ``small`` has one row per key and ``big`` may have a hot key.

    The rows of a key in ``big`` are dealt over ``salts`` partitions and each row
    of ``small`` is repeated once per salt. When ``small`` turns out small at run
    time, the adaptive planner replaces the shuffle by a broadcast.
    """
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def sized_join(
    big: DataFrame, small: DataFrame, on: list[str], rows: int, max_broadcast: int = BROADCAST_ROWS
) -> DataFrame:
    """Join with a side of ``rows`` rows, counted by the caller: broadcast within the
    bound, salted beyond it."""
    if rows <= max_broadcast:
        return big.join(F.broadcast(small), on)
    return salted_join(big, small, on, salts=salts_for(big.sparkSession, rows))


# Which of the two filters a control row sets, as bits.
_TYPE, _SOURCE = 1, 2


@dataclass(frozen=True)
class Control:
    """A control table (rules, profiles) read once: its rows, how many there are (or what they
    take in units of ``ROW_BYTES``, if more), and which filter shapes occur. Null ``f_type`` or ``f_source`` means "any"."""

    rows: DataFrame
    count: int
    shapes: tuple[int, ...]


def prepare_control(table: DataFrame) -> Control:
    shape = (
        F.when(F.col("f_type").isNotNull(), _TYPE).otherwise(0)
        + F.when(F.col("f_source").isNotNull(), _SOURCE).otherwise(0)
    )
    rows = checkpointed(table.withColumn("_rshape", shape))
    size = F.octet_length(F.to_json(F.struct("*")))
    seen = rows.select("_rshape", size.alias("_size")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("_size"), F.lit(0)).alias("size"), F.collect_set("_rshape").alias("shapes")
    ).first()
    return Control(rows, max(seen.n, -(-seen["size"] // ROW_BYTES)), tuple(sorted(seen.shapes)))


def match_filters(
    events: DataFrame, control: Control, columns: list[str], max_broadcast: int = BROADCAST_ROWS
) -> DataFrame:
    """Pair each event with the control rows whose set filters all equal it, adding
    their ``columns``.

    Each event gets one lookup key per filter shape in use, which makes the match an
    equi-join: no nested loop over the rules. A control table within the checked
    bound is broadcast and the events are not shuffled; a larger one is joined by
    salted keys, since the key of unfiltered rows is shared by every event.
    """
    shapes = control.shapes or (0,)
    keys = F.array(*[
        F.struct(
            F.lit(s).alias("_shape"),
            (F.col("event_type") if s & _TYPE else F.lit(None).cast("string")).alias("_kt"),
            (F.col("source") if s & _SOURCE else F.lit(None).cast("string")).alias("_ks"),
        )
        for s in shapes
    ])
    keyed = events.withColumn("_k", F.explode(keys) if len(shapes) > 1 else keys[0]).select(
        *[F.col(c) for c in events.columns], "_k._shape", "_k._kt", "_k._ks"
    )
    side = control.rows.select(*columns, "f_type", "f_source", "_rshape")
    on = [
        F.col("_shape") == F.col("_rshape"),
        F.col("_kt").eqNullSafe(F.col("f_type")),
        F.col("_ks").eqNullSafe(F.col("f_source")),
    ]
    if control.count <= max_broadcast:
        side = F.broadcast(side)
    else:
        salts = salts_for(events.sparkSession, control.count)
        keyed = keyed.withColumn("_salt", F.pmod(F.xxhash64("seq"), F.lit(salts)).cast("int"))
        side = side.withColumn("_rsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on.append(F.col("_salt") == F.col("_rsalt"))
    return keyed.join(side, reduce(and_, on)).drop(
        "_shape", "_kt", "_ks", "_rshape", "_salt", "_rsalt", "f_type", "f_source"
    )


def attach_control(df: DataFrame, control: Control, key: str, columns: list[str]) -> DataFrame:
    """Bring ``columns`` of a control row back by its unique key."""
    return sized_join(df, control.rows.select(key, *columns), [key], control.count)

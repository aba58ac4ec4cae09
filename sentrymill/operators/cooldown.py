"""Greedy cooldown: a candidate fires when the last fire is at least the cooldown
ago, and only a fire restarts the wait.

A chain of that kind depends on its own past. Two exact ways to run it:

* keys with a moderate number of candidate milliseconds: one sorted pass per key;
* for the other keys: time is cut into blocks some cooldowns wide. Whatever happened
  before, the first fire of a block is one of the candidates in its first
  cooldown, or the first one after that. Each block is reduced, all blocks in
  parallel, to a table "first fire -> earliest next fire"; tables of neighbouring
  blocks are chained level by level until few remain per key; then the true entry
  times go back down and each block lists its fires. No task holds more than a
  block of distinct milliseconds, however many events there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed

# Distinct candidate milliseconds of one key that a single pass may take.
DIRECT_ROWS = 5_000_000
# Blocks chained per level of the parallel form.
FAN_IN = 16
_NEVER = -(1 << 62)


def first_candidates(cands: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """The earliest arrival per key and millisecond; later ones in that millisecond
    cannot fire while a cooldown is set. Rows of keys without cooldown all stay."""
    tie = F.when(F.col("cooldown_ms") > 0, F.lit(0).cast("bigint")).otherwise(F.col("seq"))
    return (
        cands.groupBy(key, "cooldown_ms", "ts_ms", tie.alias("_tie"))
        .agg(F.min(F.struct("seq", *payload)).alias("_first"))
        .select(key, "cooldown_ms", "ts_ms", "_first.*")
    )


def apply_cooldown(
    cands: DataFrame,
    key: str,
    payload: list[str],
    earlier: DataFrame | None = None,
    first_fire_ms: int | None = None,
    direct_rows: int = DIRECT_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Candidates that fire. ``cands`` has ``key, cooldown_ms, ts_ms, seq`` and the
    payload columns.

    ``earlier`` optionally gives ``key, fire_ms`` of fires decided before this input. A
    candidate less than the cooldown after one of them can't fire; one before it can. Since
    what is left between two of them is past the wait of the first, the chain over the rest is
    the chain that takes them in. ``first_fire_ms`` is a fire that every key had.
    """
    firsts = checkpointed(first_candidates(cands, key, payload))
    free = firsts.filter(F.col("cooldown_ms") <= 0)
    held = firsts.filter(F.col("cooldown_ms") > 0)

    times = held.select(key, "cooldown_ms", "ts_ms")
    if first_fire_ms is not None:
        times = times.filter(F.col("ts_ms") - first_fire_ms >= F.col("cooldown_ms"))
    if earlier is not None:
        times = _not_held(times, earlier, key)

    # The form is chosen per key: one busy key doesn't move the others to the longer way.
    sizes = held.groupBy(key).count()
    seen = sizes.agg(F.count("*").alias("keys"), F.count_if(F.col("count") > direct_rows).alias("busy")).first()
    if not seen.keys:
        return free
    if not seen.busy:
        fires = _direct(times, key)
    else:
        busy = checkpointed(sizes.filter(F.col("count") > direct_rows).select(key))
        fires = _chained(checkpointed(times.join(busy, key, "left_semi")), key, direct_rows, fan_in)
        if seen.busy < seen.keys:
            fires = fires.unionByName(_direct(times.join(busy, key, "left_anti"), key))
    return free.unionByName(held.join(fires, [key, "ts_ms"]).select(*firsts.columns))


def _not_held(times: DataFrame, earlier: DataFrame, key: str) -> DataFrame:
    """Times that no earlier fire of their key holds back: they meet in slices one cooldown wide."""
    width = times.groupBy(key).agg(F.max("cooldown_ms").alias("_width"))
    slice_ = F.floor(F.col("fire_ms") / F.col("_width"))
    fires = (
        earlier.select(F.col(key).alias("_key"), "fire_ms").join(width, F.col("_key") == F.col(key))
        .select("_key", "fire_ms", F.explode(F.array(slice_, slice_ + 1)).alias("_slice")).distinct()
    )
    waited = F.col("ts_ms") - F.col("fire_ms")
    holds = (
        (F.col(key) == F.col("_key")) & (F.floor(F.col("ts_ms") / F.col("cooldown_ms")) == F.col("_slice"))
        & (waited >= 0) & (waited < F.col("cooldown_ms"))
    )
    return times.join(fires, holds, "left_anti")


def walk(times: np.ndarray, cooldown: int, not_before: int = _NEVER) -> np.ndarray:
    """Fire times among sorted distinct candidate times: from the known fires, those twice as
    many steps on, until all are past the end."""
    start = int(np.searchsorted(times, not_before))
    if start >= len(times):
        return np.zeros(0, dtype="int64")
    n = len(times)
    step = np.append(np.searchsorted(times, times + cooldown), n)
    fired = np.array([start])
    while True:
        further = step[fired]
        further = further[further < n]
        if not len(further):
            return times[fired].astype("int64")
        fired = np.concatenate((fired, further))
        step = step[step]


def _direct(times: DataFrame, key: str) -> DataFrame:
    def run(group: tuple, rows: pa.Table) -> pa.Table:
        return _fires(key, group[0], _sorted(rows), _cooldown(rows))

    return times.groupBy(key).applyInArrow(run, f"{key} string, ts_ms bigint")


def _chained(times: DataFrame, key: str, target_rows: int, fan_in: int) -> DataFrame:
    """``times`` by blocks, block tables chained up, entry times handed down."""
    per_block = F.greatest(F.lit(2), F.least(F.lit(64), F.floor(F.lit(target_rows) / F.col("cooldown_ms"))))
    width = (F.col("cooldown_ms") * per_block).cast("bigint")
    blocks = times.withColumn("_blk", F.floor(F.col("ts_ms") / width).cast("bigint"))

    table_type = f"{key} string, _blk bigint, cooldown_ms bigint, entry bigint, leave bigint"

    def table(group: tuple, rows: pa.Table, entry: np.ndarray, leave: np.ndarray) -> pa.Table:
        n = len(entry)
        return pa.table({
            key: pa.repeat(group[0], n),
            "_blk": pa.repeat(group[1], n),
            "cooldown_ms": np.full(n, _cooldown(rows), dtype="int64"),
            "entry": entry,
            "leave": leave,
        })

    def reduce_block(group: tuple, rows: pa.Table) -> pa.Table:
        t, cooldown = _sorted(rows), _cooldown(rows)
        # Entries: candidates within one cooldown of the first, and the next one.
        # A superset of those within one cooldown of the block's edge.
        n = int(np.searchsorted(t, t[0] + cooldown)) + 1
        return table(group, rows, t[:n], (t[_last_fire(t, cooldown)] + cooldown)[:n])

    def chain_blocks(group: tuple, rows: pa.Table) -> pa.Table:
        parts = _tables(rows)
        final = [None] * len(parts)
        for k in range(len(parts) - 1, -1, -1):
            reached = parts[k][2].copy()
            pending = np.ones(len(reached), dtype=bool)
            for j in range(k + 1, len(parts)):
                at = np.searchsorted(parts[j][1], reached)
                hit = pending & (at < len(parts[j][1]))
                # later blocks are already chained to the end
                reached[hit] = final[j][at[hit]]
                pending &= ~hit
                if not pending.any():
                    break
            final[k] = reached
        # The second block's first entry stands for all candidates past the first block.
        entry = [parts[0][1]] + [p[1][:1] for p in parts[1:2]]
        leave = [final[0]] + [f[:1] for f in final[1:2]]
        return table(group, rows, np.concatenate(entry), np.concatenate(leave))

    parent = F.floor(F.col("_blk") / F.lit(fan_in)).cast("bigint")
    levels = [checkpointed(blocks.groupBy(key, "_blk").applyInArrow(reduce_block, table_type))]
    while _longest_span(levels[-1], key) > fan_in:
        up = levels[-1].withColumn("_parent", parent).groupBy(key, "_parent").applyInArrow(chain_blocks, table_type)
        levels.append(checkpointed(up))

    def enter_blocks(key_value: pa.Scalar, rows: pa.Table, at: int) -> pa.Table:
        numbers, entered = [], []
        for blk, entry, leave in _tables(rows):
            numbers.append(blk)
            entered.append(at)
            i = int(np.searchsorted(entry, at))
            if i < len(entry):
                at = int(leave[i])
        return pa.table({
            key: pa.repeat(key_value, len(numbers)),
            "_blk": pa.array(numbers, pa.int64()),
            "not_before_ms": pa.array(entered, pa.int64()),
        })

    def enter_top(group: tuple, rows: pa.Table) -> pa.Table:
        return enter_blocks(group[0], rows, _NEVER)

    def enter_children(group: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
        return enter_blocks(group[0], rows, known.column("not_before_ms")[0].as_py())

    entry_type = f"{key} string, _blk bigint, not_before_ms bigint"
    entries = levels[-1].groupBy(key).applyInArrow(enter_top, entry_type)
    for below in reversed(levels[:-1]):
        entries = checkpointed(
            below.withColumn("_parent", parent)
            .groupBy(key, "_parent")
            .cogroup(entries.withColumnRenamed("_blk", "_parent").groupBy(key, "_parent"))
            .applyInArrow(enter_children, entry_type)
        )

    def list_fires(group: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
        start = known.column("not_before_ms")[0].as_py()
        return _fires(key, group[0], _sorted(rows), _cooldown(rows), start)

    return (
        blocks.groupBy(key, "_blk")
        .cogroup(entries.groupBy(key, "_blk"))
        .applyInArrow(list_fires, f"{key} string, ts_ms bigint")
    )


def _sorted(rows: pa.Table) -> np.ndarray:
    return np.sort(rows.column("ts_ms").to_numpy())


def _cooldown(rows: pa.Table) -> int:
    return rows.column("cooldown_ms")[0].as_py()


def _fires(key: str, value: pa.Scalar, times: np.ndarray, cooldown: int, not_before: int = _NEVER) -> pa.Table:
    fired = walk(times, cooldown, not_before)
    return pa.table({key: pa.repeat(value, len(fired)), "ts_ms": fired})


def _last_fire(t: np.ndarray, cooldown: int) -> np.ndarray:
    """Index of the last fire in ``t`` for each possible first fire."""
    n = len(t)
    step = np.searchsorted(t, t + cooldown)
    step = np.where(step < n, step, np.arange(n))
    while True:
        further = step[step]
        if np.array_equal(further, step):
            return step
        step = further


def _tables(rows: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Block tables of a group in time order, each sorted by entry time."""
    blk, entry, leave = (rows.column(c).to_numpy() for c in ("_blk", "entry", "leave"))
    order = np.lexsort((entry, blk))
    blk, entry, leave = blk[order], entry[order], leave[order]
    numbers, starts = np.unique(blk, return_index=True)
    return [
        (int(n), e, x) for n, e, x in zip(numbers, np.split(entry, starts[1:]), np.split(leave, starts[1:]))
    ]


def _longest_span(table: DataFrame, key: str) -> int:
    span = table.groupBy(key).agg((F.max("_blk") - F.min("_blk") + 1).alias("n"))
    return span.agg(F.max("n")).first()[0] or 0

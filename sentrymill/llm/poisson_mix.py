"""Mixing sources to target weights by Poisson replication.

A document of a source whose share shall be raised or lowered by the rate r is repeated k
times, k drawn from the Poisson distribution of mean r by inversion of a uniform number that a
hash of seed and id gives. No counter is shared, so tasks can run again and agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SEED = 20240131
# Sources are weighted by this power of their row counts where no weights are given.
POWER = 0.5
# A draw has at most this mean (exp(-mean) must not vanish); higher rates are sums of several
# independent draws, which is again Poisson.
DRAW_MEAN = 500
# The table of rates is broadcast up to so many bytes; a larger one is joined by salted keys.
BROADCAST_BYTES = 32 << 20
SALTS = 32


def _digits(seed: int, *parts: Column) -> Column:
    """md5 of seed and parts, as 32 hex digits; null counts as empty text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the digest."""
    return F.conv(F.substring(_digits(seed, *parts), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def shuffle_key(id_col: Column, copy: Column, seed: int = SEED) -> Column:
    """Where a copy stands in the global order: 16 hex digits."""
    return F.substring(_digits(seed + 1, id_col, copy), 1, 16)


def source_rates(docs: DataFrame, source_col: str = "source", weights: dict | None = None, rows: float | None = None) -> DataFrame:
    """(source, n, rate, draws, cdf) of each source.

    ``weights`` maps sources to target weights (missing ones 0, so their documents go); without
    it, the weight is the row count to the power ``POWER``. ``rows`` is the number of rows
    aimed at, by default as many as there are. Null is a source of its own.
    """
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(POWER)) if POWER != 0.5 else F.sqrt("n")
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(w)).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    total = counts.agg(F.sum("n").alias("n"), F.sum("weight").alias("w")).first()
    aim = F.lit(float(total.n or 0) if rows is None else float(rows)) / F.lit(total.w or 1.0)
    draw = F.col("rate") / F.col("draws")
    longest = F.ceil(draw + 10 * F.sqrt(draw) + 30)
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.col("longest").cast("int")),
        F.struct(F.exp(-F.col("mean")).alias("p"), F.exp(-F.col("mean")).alias("c"), F.array(F.exp(-F.col("mean"))).alias("all")),
        lambda s, k: F.struct(
            (s["p"] * F.col("mean") / k).alias("p"), (s["c"] + s["p"] * F.col("mean") / k).alias("c"),
            F.concat(s["all"], F.array(s["c"] + s["p"] * F.col("mean") / k)).alias("all")),
        lambda s: s["all"],
    )
    return (
        counts.withColumn("rate", aim * F.col("weight") / F.col("n"))
        .withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / DRAW_MEAN)).cast("int"))
        .withColumn("mean", draw).withColumn("longest", longest).withColumn("cdf", cdf)
        .select("source", "n", "rate", "draws", "cdf")
    )


def repetitions(seed: int, id_col: Column, draws: Column, cdf: Column) -> Column:
    """The Poisson count: in each draw, how many steps of the distribution lie at or below u."""
    return F.aggregate(
        F.sequence(F.lit(0), draws - 1), F.lit(0),
        lambda n, k: n + F.size(F.filter(cdf, lambda c: c <= uniform(seed, id_col, k))))


def replicated(
    docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", weights: dict | None = None,
    rows: float | None = None, seed: int = SEED, shuffle: bool = True,
) -> DataFrame:
    """struct ``doc`` of all columns, ``rate``, ``n_copies``, ``copy`` (from 0), ``shuffle_key``; one row per copy.

    In the order of ``shuffle_key``, a digest of seed, id and copy, over all partitions. A null
    id is drawn as an empty one, a null source is a source; rows with equal ids are
    repeated equally often. Rows whose count is 0 go. Text takes no part; it may be anything.
    """
    rates = source_rates(docs, source_col, weights, rows)
    size = rates.agg(F.sum(F.size("cdf") * 8 + F.coalesce(F.length("source"), F.lit(0)) * 4 + 64)).first()[0] or 0
    rows_ = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rates = rates.select(F.col("source").alias("of"), "rate", "draws", "cdf")
    source = F.col("doc")[source_col].cast("string").eqNullSafe(F.col("of"))
    if size <= BROADCAST_BYTES:
        joined = rows_.join(F.broadcast(rates), source)
    else:  # a source with very many rows is spread over the salts
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        at = F.pmod(F.xxhash64(F.col("doc")[id_col]), F.lit(SALTS)).cast("int")
        joined = rows_.withColumn("at", at).join(salted, source & (F.col("at") == F.col("salt")))
    id_ = F.col("doc")[id_col]
    out = (
        joined.withColumn("n_copies", repetitions(seed, id_, F.col("draws"), F.col("cdf"))).where("n_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
        .withColumn("shuffle_key", shuffle_key(id_, F.col("copy"), seed))
        .select("doc", "rate", "n_copies", "copy", "shuffle_key")
    )
    return out.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key") if shuffle else out


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with rows repeated to the target weights and shuffled globally; the same columns."""
    return replicated(docs, **options).select(*[F.col("doc")[c].alias(c) for c in docs.columns])

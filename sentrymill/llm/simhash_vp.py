"""SimHash near-duplicates, with fingerprints sharded by vantage-point trees.

A tree node has a vantage point and a radius: fingerprints within the radius go inside, the
others outside. A fingerprint inside, at distance d with ``d + max_distance > radius``, may
have partners outside, so it visits the outside branch too; by the triangle inequality no
other pair is parted. Hence each pair within ``max_distance`` meets in at least one shard,
and the result is exact. In a shard the same rule prunes a local tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .components import Forest, connected_components
from .text import LOWER_TABLE, SPACES, Words, mix, new_name, runs, steps, written

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
SEED = 42
# Distinct fingerprints aimed at per shard, and the most levels of the sharding tree; with more
# fingerprints than these give room for, shards grow.
SHARD_ROWS = 4096
MAX_LEVELS = 16
# Distinct fingerprints that vantage points and radii are fitted on, about (picked by hash): so
# many per shard, and at most so many. All are indexed; the sample only moves how even shards are.
SAMPLE_PER_SHARD, SAMPLE_ROWS = 64, 1 << 16
# Fingerprints compared pair by pair at the end of a branch.
LEAF_ROWS = 384


# ---- fingerprints ------------------------------------------------------------------------


def fingerprints(texts: pa.Array, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit SimHash of each text: bits set in over half of its word shingles' hashes."""
    w = Words(texts, LOWER_TABLE, SPACES, collapse=True)
    n = w.counts
    size = np.minimum(n, shingle)
    many = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    head = np.repeat(w.first[:-1], many) + runs(many)
    tail = head + np.repeat(size - 1, many)
    body, digest = w.data.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter(
        (digest(body[a:b], SEED) for a, b in zip(w.start[head].tolist(), w.end[tail].tolist())), np.uint64, len(head))
    out = np.zeros(len(n), np.uint64)
    have = many > 0
    if have.any():
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        at = (np.cumsum(many) - many)[have]
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.uint32)
        out[have] = np.packbits(2 * ones > many[have, None], axis=1).view(">u8")[:, 0]
    return out


def with_fingerprint(docs: DataFrame, text_col: str, name: str, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """All columns of ``docs`` and the fingerprint as a signed 64-bit integer."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_col):
            found = pa.array(fingerprints(batch.column(text_col), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    return docs.mapInArrow(add, schema)


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


# ---- sharding tree -----------------------------------------------------------------------


class ShardTree:
    """A complete binary tree of vantage points, fitted on a sample; node k has children 2k+1, 2k+2."""

    def __init__(self, sample: np.ndarray, levels: int, max_distance: int):
        self.levels, self.max_distance = levels, max_distance
        inner = (1 << levels) - 1
        self.vantage, self.radius = np.zeros(inner, np.uint64), np.full(inner, 31, np.int64)
        node = np.zeros(len(sample), np.int64)
        for level in range(levels):
            first = (1 << level) - 1
            order = np.argsort(node, kind="stable")
            at = np.searchsorted(node[order], np.arange(first, first + (1 << level) + 1))
            for k, (a, b) in enumerate(zip(at, at[1:]), first):
                if b > a:
                    own = sample[order[a:b]]
                    self.vantage[k] = own[0]
                    self.radius[k] = int(np.median(np.bitwise_count(own ^ own[0])))
            inside = np.bitwise_count(sample ^ self.vantage[node]) <= self.radius[node]
            node = np.where(inside, 2 * node + 1, 2 * node + 2)

    def route(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) for every shard that each fingerprint belongs to or visits."""
        row, node = np.arange(len(f)), np.zeros(len(f), np.int64)
        for _ in range(self.levels):
            d = np.bitwise_count(f[row] ^ self.vantage[node]).astype(np.int64)
            inside, visits = d <= self.radius[node], d + self.max_distance > self.radius[node]
            row = np.concatenate((row[inside], row[visits]))
            node = np.concatenate((2 * node[inside] + 1, 2 * node[visits] + 2))
        return row, node - ((1 << self.levels) - 1)


def links_in_shard(f: np.ndarray, max_distance: int) -> np.ndarray:
    """For each of the distinct fingerprints, the index of the smallest one it is linked to in the shard.

    Links go into a union structure block by block, so a dense group costs no memory for its pairs.
    """
    forest = Forest(len(f))
    branches = [np.arange(len(f))]
    while branches:
        own = branches.pop()
        if len(own) > LEAF_ROWS:
            g = f[own]
            d = np.bitwise_count(g ^ g[len(g) // 2]).astype(np.int64)
            radius = int(np.median(d))
            inside, visits = d <= radius, d + max_distance > radius
            if max(inside.sum(), visits.sum()) < 0.95 * len(own):
                branches += [own[inside], own[visits]]
                continue
        g = f[own]
        block = max(1, (1 << 18) // max(1, len(own)))
        for k in range(0, len(own), block):
            x, y = np.nonzero(np.bitwise_count(g[k:k + block, None] ^ g[None, k:]) <= max_distance)
            apart = x < y
            forest.link(own[x[apart] + k], own[y[apart] + k])
    return forest.label


# ---- Spark -------------------------------------------------------------------------------


def linked_fingerprints(distinct: DataFrame, max_distance: int = MAX_DISTANCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(node, root) of each fingerprint with a partner within ``max_distance`` bits.

    ``distinct`` has each fingerprint ``f`` once and is read several times. Each shard gives
    the links of a spanning forest, not its pairs.
    """
    n = distinct.count()
    levels = min(MAX_LEVELS, max(0, int(np.ceil(np.log2(max(1, n) / shard_rows)))))
    wanted = min(SAMPLE_ROWS, SAMPLE_PER_SHARD << levels)
    below = int(min(1.0, wanted / max(1, n)) * (1 << 63))
    picked = distinct.where(F.xxhash64("f").bitwiseAND((1 << 63) - 1) <= below - 1).select("f").toArrow()
    sample = picked.column("f").combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)
    tree = ShardTree(sample[np.argsort(mix(sample))], levels, max_distance)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("f").to_numpy(zero_copy_only=False)
            row, shard = tree.route(f.view(np.uint64))
            yield pa.RecordBatch.from_pydict({"shard": shard.astype(np.int32), "f": f[row]})

    def link(table: pa.Table) -> pa.Table:
        f = np.sort(table.column("f").combine_chunks().to_numpy(zero_copy_only=False))
        to = f[links_in_shard(f.view(np.uint64), max_distance)]
        apart = to != f
        return pa.table({"a": f[apart], "b": to[apart]})

    shards = distinct.select("f").mapInArrow(route, "shard int, f long")
    return connected_components(shards.groupBy("shard").applyInArrow(link, "a long, b long"))


def _classes(rows: DataFrame, item: Column) -> DataFrame:
    """Each distinct fingerprint ``f`` with the smallest ``item`` that has it."""
    return written(rows.groupBy("f").agg(F.min(item).alias("first")), "simhash-classes")


def near_duplicate_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest id reachable) per row.

    Null text counts as empty; texts without words have fingerprint zero and are linked like
    others. Fewer words than a shingle has make one shingle. Repeated rows each give a row.
    A null id takes part and is never the smallest, unless a component has no other.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(with_fingerprint(rows, "text", "f", shingle).select("doc_id", "f"), "simhash-rows")
    classes = _classes(rows, F.col("doc_id"))
    linked = classes.join(
        linked_fingerprints(classes, max_distance).withColumnRenamed("node", "f"), "f", "left"
    ).select("f", "first", F.coalesce("root", "f").alias("root"))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    component = written(linked.join(least, "root").select("f", "component_id"), "simhash-components")
    return rows.join(component, "f").select("doc_id", hex_digits(F.col("f")).alias("fingerprint"), "component_id")


def drop_near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (nulls last).

    Rows equal in id are told apart by their place, so one of repeated rows stays.
    """
    f, place = (new_name(docs, x) for x in ("fingerprint", "place"))
    rows = written(
        with_fingerprint(docs, text_col, f, shingle).withColumn(place, F.monotonically_increasing_id()), "simhash-docs")
    item = F.struct(F.col("id").isNull().alias("none"), "id", "place")
    classes = _classes(rows.select(F.col(f).alias("f"), F.col(id_col).alias("id"), F.col(place).alias("place")), item)
    kept = (
        classes.join(linked_fingerprints(classes, max_distance).withColumnRenamed("node", "f"), "f", "left")
        .groupBy(F.coalesce("root", "f").alias("root")).agg(F.min("first").alias("first"))
        .select(F.col("first.place").alias(place))
    )
    return rows.join(kept, place, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


"""Exact duplicates against an index of digests seen before, by minimal perfect hashing.

The index has a shard per run of hash values. In a shard, levels of bit arrays hash its n distinct
digests one to one onto slots 0 to n-1: at each level the digests that fall on a bit of their
own stay there, the others go on to the next; a digest's slot is the number of set bits before
its own. A slot holds the whole digest and the row that stays, so a look-up reads one slot and
compares all bytes: equal means seen before, else the digest is new.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .text import LOWER_TABLE, flat, mix, steps, written

# Distinct digests aimed at per shard.
SHARD_KEYS = 1 << 17
# Bits of a level per digest that reaches it.
LOAD = 1.5


class PerfectHash:
    """Maps n distinct digests one to one onto 0..n-1; other digests onto any of these, or to -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *[int(bits.sum()) for bits in levels]])
        self.ranks = [np.cumsum(bits) - bits for bits in levels]

    @classmethod
    def over(cls, words: np.ndarray) -> PerfectHash:
        """``words``: distinct digests as rows of four 64-bit numbers."""
        levels = []
        while len(words):
            at = _places(words, len(levels), int(len(words) * LOAD) + 1)
            bits = np.bincount(at, minlength=int(len(words) * LOAD) + 1) == 1
            levels.append(bits)
            words = words[~bits[at]]
        return cls(levels)

    def slots(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, np.int64)
        left = np.arange(len(words))
        for k, bits in enumerate(self.levels):
            at = _places(words[left], k, len(bits))
            here = bits[at]
            out[left[here]] = self.before[k] + self.ranks[k][at[here]]
            left = left[~here]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return sizes.tobytes() + np.packbits(np.concatenate([*self.levels, np.zeros(0, bool)])).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        ends = np.cumsum(np.frombuffer(data, np.int64, n, 8))
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=8 * (n + 1))).view(bool)
        return cls(np.split(bits[:ends[-1]], ends[:-1]) if n else [])


def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where a level puts each digest: a hash of its four numbers that differs by level."""
    factors = mix(np.arange(4, dtype=np.uint64) + np.uint64(4 * level + 1)) | np.uint64(1)
    return (mix((words * factors).sum(axis=1, dtype=np.uint64)) % np.uint64(size)).astype(np.int64)


def _words(digests: pa.ChunkedArray) -> np.ndarray:
    """Digests of 32 bytes as rows of four 64-bit numbers."""
    return np.frombuffer(bytearray().join(digests.to_pylist()), "<u8").reshape(-1, 4)


# ---- rows --------------------------------------------------------------------------------


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest) per row: the SHA-256 of the text, A-Z lower-cased; null text counts as empty."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([slim.schema["id"], T.StructField("digest", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            body, ends = flat(batch.column("text"))
            data = memoryview(np.frombuffer(LOWER_TABLE, np.uint8)[body])
            digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(ends.tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digests, pa.binary())], ["id", "digest"])

    return slim.mapInArrow(run, schema)


def distinct_digests(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, digest, id, row, n): of rows (id, row, digest) with one digest, the one that stays
    (largest id; of rows equal in id any one, and ids before nulls) and how many there are.

    Copies collapse before the shuffle.
    """
    return rows.groupBy("digest").agg(
        F.max("id").alias("id"), F.coalesce(F.max_by("row", "id"), F.max("row")).alias("row"), F.count("*").alias("n"),
    ).select(_shard(shards).alias("shard"), "digest", "id", "row", "n")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def shards_for(rows: int) -> int:
    return max(1, -(-rows // SHARD_KEYS))


# ---- index -------------------------------------------------------------------------------


def build_index(history: DataFrame) -> DataFrame:
    """The index over distinct digests (shard, digest, id, row, n): a row per slot, and in slot 0
    of each shard the bit arrays that lead to its slots."""
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), *history.schema.fields[1:],
        T.StructField("levels", T.BinaryType()),
    ])

    def build(table: pa.Table) -> pa.Table:
        words = _words(table.column("digest"))
        hashed = PerfectHash.over(words)
        slot = hashed.slots(words)
        order = np.argsort(slot)
        out = table.take(pa.array(order)).add_column(1, "slot", pa.array(slot[order]))
        return out.append_column("levels", pa.array([hashed.to_bytes(), *[None] * (len(order) - 1)], pa.binary()))

    return history.groupBy("shard").applyInArrow(build, schema)


def looked_up(incoming: DataFrame, index: DataFrame) -> DataFrame:
    """(digest, id, row, n, seen) of every distinct digest of the index or of ``incoming``, which has the
    form of ``distinct_digests`` with as many shards as the index.

    A seen digest keeps the row in its slot unless a larger id came in; the new ones are groups of
    their own. ``n`` adds up both sides; ``seen`` says whether the index has the digest.
    """
    columns = [f for f in incoming.schema.fields if f.name != "shard"]
    schema = T.StructType([*columns, T.StructField("seen", T.BooleanType())])
    names = [f.name for f in columns]

    def look(came: pa.Table, stored: pa.Table) -> pa.Table:
        new = came.select(names)
        if not stored.num_rows:
            return new.append_column("seen", pa.array(np.zeros(new.num_rows, bool)))
        stored = stored.take(pc.sort_indices(stored.column("slot")))
        slots = stored.select(names)
        held = _words(slots.column("digest"))
        asked = _words(new.column("digest"))
        at = PerfectHash.from_bytes(stored.column("levels")[0].as_py()).slots(asked)
        hit = (at >= 0) & (held[np.maximum(at, 0)] == asked).all(axis=1)
        repeats, place = new.filter(pa.array(hit)), at[hit]
        # The row of each slot, or the one that came in: distinct digests meet a slot at most once.
        newer = _larger(repeats.column("id"), slots.column("id").take(pa.array(place)))
        pick = np.arange(len(held))
        pick[place[newer]] = len(held) + np.flatnonzero(newer)
        both = pa.concat_tables([slots, repeats.cast(slots.schema)]).take(pa.array(pick))
        n = slots.column("n").to_numpy().copy()
        n[place] += repeats.column("n").to_numpy()
        kept = pa.table({"digest": slots.column("digest"), "id": both.column("id"), "row": both.column("row"), "n": n}).select(names)
        fresh = new.filter(pa.array(~hit))
        seen = np.arange(len(held) + fresh.num_rows) < len(held)
        return pa.concat_tables([kept, fresh.cast(kept.schema)]).append_column("seen", pa.array(seen))

    return incoming.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(look, schema)


def _larger(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """Where a > b, with null the smallest."""
    known = pc.and_(pc.is_valid(a), pc.or_(pc.is_null(b), pc.fill_null(pc.greater(a, b), False)))
    return known.to_numpy().astype(bool)


# ---- operators ---------------------------------------------------------------------------


def new_texts(docs: DataFrame, index: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest) of the texts that the index doesn't hold, one row each: what a further delivery adds."""
    rows = digested(docs, id_col, text_col).withColumn("row", F.lit(0).cast("long"))
    found = looked_up(distinct_digests(rows, shards), index)
    return found.where("NOT seen").select(F.col("id").alias(id_col), "digest")


def exact_duplicates(docs: DataFrame, history: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row, dropped ones too.

    ``history``, a condition on ``id``, says which rows the index is built from; the others are looked up in
    it. The result is the same for any choice; null counts as no. Texts are equal if the same after A-Z are lower-cased; null
    text counts as empty. Of equal texts the row with the largest id stays; rows that repeat it
    share its group and are dropped. A null id is smaller than any other. An empty table gives
    no row. Only the named columns are read.
    """
    rows = written(digested(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "digest-rows")
    shards = shards_for(rows.count())
    old = F.coalesce(history, F.lit(False))
    index = written(build_index(distinct_digests(rows.where(old), shards)), "digest-index")
    groups = looked_up(distinct_digests(rows.where(~old), shards), index).select(
        F.col("digest"), F.col("id").alias("keep_id"), F.col("row").alias("_kept"), F.col("n").alias("group_size"))
    return rows.join(groups, "digest").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("_kept")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def older_half(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Ids up to the middle of their range."""
    ends = docs.agg(F.min(id_col).cast("decimal(38,0)").alias("lo"), F.max(id_col).cast("decimal(38,0)").alias("hi")).first()
    return F.col("id") <= F.lit(0 if ends.lo is None else int((ends.lo + ends.hi) // 2))

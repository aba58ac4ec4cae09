"""Texts of Arrow batches as flat numpy arrays of words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, functions as F

from ..session import table_folder

# Text bytes that one numpy step works on at most (one longer text is a step of its own).
STEP_BYTES = 2 << 20

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
# Lower-cases A-Z and turns every byte outside 0-9, a-z and non-ASCII into a space.
ALNUM_TABLE = bytes(
    b + 32 if b in UPPER else b if b >= 0x80 or b in LOWER or 0x30 <= b <= 0x39 else 0x20 for b in range(256)
)
LOWER_TABLE = bytes(b + 32 if b in UPPER else b for b in range(256))
SAME_TABLE = bytes(range(256))

_MULTIPLIER = 0x9E6C63D0876A9A99
_M64 = (1 << 64) - 1


def filled(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The text column with null as empty text, as one large_string array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def steps(batches: Iterator[pa.RecordBatch], text: str, step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``step_bytes`` of text; none is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        run = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)[:-1])) // step_bytes
        cuts = np.flatnonzero(np.diff(run)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the offsets of each text in them."""
    column = filled(column)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, ends - ends[0]


class Words:
    """Words of a run of texts.

    ``data``: mapped bytes; ``start``, ``end``: byte ranges of the words in it;
    ``first``: index of the first word of each text, with the total at the end.
    ``collapse`` makes one space of each run of separators, so that ``data`` from the start
    of a word to the end of a later one has the words between them joined by one space.
    """

    def __init__(self, column: pa.Array, table: bytes, separators: bytes = b"\x20", collapse: bool = False):
        body, ends = flat(column)
        self.data = np.frombuffer(table, np.uint8)[body]
        apart = np.zeros(256, bool)
        apart[list(separators)] = True
        inside = ~apart[self.data]
        if collapse:
            kept = inside.copy()
            kept[1:] |= inside[:-1]
            kept[ends[:-1][ends[:-1] < len(kept)]] = True
            self.data = np.where(inside, self.data, np.uint8(0x20))[kept]
            ends = np.concatenate(([0], np.cumsum(kept)))[ends]
            inside = inside[kept]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = ends[1:-1]
        cuts = cuts[cuts < len(inside)]
        begins[cuts] = inside[cuts]
        stops = np.zeros(len(inside) + 1, bool)
        stops[1:] = inside
        stops[:-1] &= begins | ~inside
        stops[0] = False
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops)
        self.first = np.searchsorted(self.start, ends)
        self.ends = ends
        self._hashes = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if self._hashes is None:
            self._hashes = span_hashes(self.data, self.start, self.end)
        return self._hashes


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: a polynomial in an odd number modulo 2**64, mixed."""
    n = len(data)
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start])


class _Tables(dict):
    """Filled where it is used: what is sent to other processes is empty."""

    def __reduce__(self):
        return (_Tables, ())


_TABLES = _Tables()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse, modulo 2**64."""
    for name, factor in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
        if len(_TABLES.get(name, ())) < n:
            steps_ = np.full(n + n // 4, factor, np.uint64)
            steps_[0] = 1
            _TABLES[name] = np.cumprod(steps_)
    return _TABLES["up"], _TABLES["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(h: np.ndarray, offsets: list[int] | range) -> np.ndarray:
    """Hashes of the elements ``h[i + o] for o in offsets``, for each i where all exist."""
    span = max(offsets) + 1
    n = max(0, len(h) - span + 1)
    out = np.zeros(n, np.uint64)
    for k, o in enumerate(offsets):
        out += h[o:o + n] * np.uint64((_MULTIPLIER * (2 * k + 3)) ** 3 & _M64 | 1)
    return mix(out)


def runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .., n-1 for each length n, in a row."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def remainder(id_text: str | None, modulus: int) -> int:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return zlib.crc32((id_text or "").encode()) % modulus


def remainder_column(id_col: str, modulus: int) -> Column:
    """As ``remainder``, on a DataFrame column."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % F.lit(modulus)


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a Hadoop-style location."""
    if path.startswith("file:"):
        path = re.sub("^file:/+", "/", path)
    if "://" in path:
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder (inside ``scratch``, in one that is deleted at
    its end); later reads don't compute it again."""
    spark = df.sparkSession
    path = table_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def revived(kind: type, state: dict):
    """An object from its ``vars``: what is broadcast names no class that workers may not find."""
    out = kind.__new__(kind)
    out.__dict__.update(state)
    return out


def new_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it where ``df`` has a column of that name."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name

"""Spelling variants: words one edit apart, found with k-d trees over letter counts.

A word is a point: how often it has each letter, and its length. A replaced letter lowers one
count by one and raises another, an inserted letter raises one, so words one edit apart lie at most
2 apart (L1), and of one length, or of lengths that differ by one. Searches for these two
length pairs prune the boxes of a tree; the words met are compared letter by letter. A tree
fitted on a sample shards the words: each goes to the box it lies in, and visits the boxes that its
searches reach.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed
from .text import LOWER_TABLE, filled, revived, written

# Which words count, which lose a letter, and how much more often a form is.
MIN_LETTERS = 7
MIN_COUNT = 2
MODULUS = 31
FORM_RATIO = 10

RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % MIN_LETTERS)
OTHER = re.compile("[^A-Za-zÀ-ÿ]")
# Characters of a text whose runs are listed at a time, and distinct words a task holds.
PIECE_CHARS = 1 << 20
HELD_WORDS = 1 << 18

# Counts of a-z, and of the other letters in six groups by code.
LETTERS = 32
LETTER_OF = np.array([c - 97 if 97 <= c < 123 else 26 + c % 6 for c in range(256)])
# The length is a coordinate too, weighted so that a difference of one is out of reach.
LENGTH_WEIGHT = 4
FAR = 1 << 14

# Words aimed at per shard; shards grow beyond this many shards. The tree is fitted on some
# SAMPLE_PER_SHARD words a shard (picked by hash); all words are in it.
SHARD_WORDS = 1 << 13
MAX_SHARDS = 1 << 14
SAMPLE_PER_SHARD = 64
LEAF_WORDS = 48
# Comparisons of numbers done at a time.
STEP_CELLS = 1 << 22


# ---- words -------------------------------------------------------------------------------


def text_words(id_text: str, text: str) -> Counter:
    """Words of one text with their numbers; a run picked by its hash loses a letter."""
    prefix = zlib.crc32(f"{id_text}:".encode())
    runs, at = Counter(), 0
    while at < len(text):
        gap = OTHER.search(text, at + PIECE_CHARS)
        end = gap.start() if gap else len(text)
        runs.update(RUN.findall(text, at, end))
        at = end
    found = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), prefix)
        if h % MODULUS == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1:]
            if len(run) < MIN_LETTERS:
                continue
        found[run] += n
    return found


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words with enough letters that occur often enough over all texts."""
    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))

    def listed(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for batch in batches:
            for id_text, text in zip(filled(batch.column("id")), filled(batch.column("text"))):
                lowered = text.as_buffer().to_pybytes().translate(LOWER_TABLE).decode() if text.as_buffer() else ""
                held.update(text_words(id_text.as_py(), lowered))
                if len(held) > HELD_WORDS:
                    yield listed(held)
                    held.clear()
        yield listed(held)

    return slim.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# ---- points and trees --------------------------------------------------------------------


class WordTable:
    """Letters of words in a row, and the points they are."""

    def __init__(self, words: pa.Array | pa.ChunkedArray):
        self.letters = np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8)
        self.length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        cell = np.repeat(np.arange(len(self.length)) * LETTERS, self.length) + LETTER_OF[self.letters]
        counts = np.bincount(cell, minlength=len(self.length) * LETTERS).reshape(-1, LETTERS)
        self.points = np.minimum(np.column_stack((counts, LENGTH_WEIGHT * self.length)), FAR - 1).astype(np.int16)

    def longer(self) -> np.ndarray:
        """Points as if the words had one letter more."""
        points = self.points.copy()
        points[:, -1] = np.minimum(LENGTH_WEIGHT * (self.length + 1), FAR - 1)
        return points

    def rows(self, at: np.ndarray, length: int) -> np.ndarray:
        return self.letters[self.start[at][:, None] + np.arange(length)]


class BoxTree:
    """A k-d tree. Boxes are those of the points, or (``whole``) those the cuts make of all space; then
    leaves keep no points."""

    def __init__(self, points: np.ndarray, leaf_rows: int, whole: bool = False):
        d = points.shape[1]
        self.cut: list[tuple[int, int, int, int] | None] = []
        self.low, self.high, self.members = [], [], []
        todo = [(np.arange(len(points)), np.full(d, -FAR, np.int16), np.full(d, FAR, np.int16), None, 0)]
        while todo:
            own, low, high, parent, side = todo.pop()
            node = len(self.cut)
            if parent is not None:
                axis, at, *below = self.cut[parent]
                below[side] = node
                self.cut[parent] = (axis, at, *below)
            here = points[own]
            if not whole and len(own):
                low, high = here.min(axis=0), here.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            found = _best_cut(here) if len(own) > leaf_rows else None
            if found is None:
                self.cut.append(None)
                self.members.append(None if whole else own)
                continue
            axis, at = found
            self.cut.append((axis, at, -1, -1))
            self.members.append(None)
            left = here[:, axis] <= at
            top, bottom = high.copy(), low.copy()
            top[axis], bottom[axis] = at, at + 1
            todo.append((own[~left], bottom, high, node, 1))
            todo.append((own[left], low, top, node, 0))

    def own_leaf(self, points: np.ndarray) -> np.ndarray:
        """The leaf each point lies in."""
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.cut[node] is None:
                out[rows] = node
                continue
            axis, at, left, right = self.cut[node]
            low = points[rows, axis] <= at
            todo += [(left, rows[low]), (right, rows[~low])]
        return out

    def reached(self, points: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of ``points``) for the leaves whose box has a place with counts raised by at
        most ``up`` and lowered by at most ``down`` in all."""
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            kept = []
            step = max(1, STEP_CELLS // points.shape[1])
            for k in range(0, len(rows), step):
                part = points[rows[k:k + step]]
                raised = np.maximum(self.low[node] - part, 0).sum(axis=1)
                lowered = np.maximum(part - self.high[node], 0).sum(axis=1)
                kept.append(rows[k:k + step][(raised <= up) & (lowered <= down)])
            rows = np.concatenate(kept) if kept else rows
            if not len(rows):
                continue
            if self.cut[node] is None:
                yield node, rows
            else:
                todo += [(k, rows) for k in self.cut[node][2:]]


def _best_cut(points: np.ndarray) -> tuple[int, int] | None:
    """Axis and value that part the points most evenly; the length if it does so at all well, as
    it alone makes no word visit the other side. None if all points are the same."""
    half = np.sort(points, axis=0)[len(points) // 2]
    cuts = np.stack((half, half - 1))
    left = np.stack([(points <= c).sum(axis=0) for c in cuts])
    even = np.minimum(left, len(points) - left)
    k = int(even[:, -1].argmax())
    axis = points.shape[1] - 1
    if even[k, axis] < len(points) // 4:
        k, axis = np.unravel_index(even.argmax(), even.shape)
    return (int(axis), int(cuts[k, axis])) if even[k, axis] else None


# ---- near words --------------------------------------------------------------------------


def one_edit_apart(table: WordTable, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b, of one length or b one letter longer, are exactly one edit apart."""
    out = np.zeros(len(a), bool)
    length = table.length[a]
    for n in np.unique(length):
        group = np.flatnonzero(length == n)
        step = max(1, STEP_CELLS // int(n + 1))
        for k in range(0, len(group), step):
            at = group[k:k + step]
            x = table.rows(a[at], n)
            same = table.length[b[at]] == n
            y = table.rows(b[at[same]], n)
            out[at[same]] = (x[same] != y).sum(axis=1) == 1
            y = table.rows(b[at[~same]], n + 1)
            front = np.logical_and.accumulate(x[~same] == y[:, :-1], axis=1).sum(axis=1)
            back = np.logical_and.accumulate((x[~same] == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            out[at[~same]] = front + back >= n
    return out


def near_pairs(words: pa.Array | pa.ChunkedArray, inside: np.ndarray, same: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Pairs of indices of words one edit apart, each once.

    ``inside``: which words lie here; they are searched by all of them and by the visitors: those
    marked ``same`` for words of their length, those marked ``longer`` for words one letter longer.
    """
    table = WordTable(words)
    home = np.flatnonzero(inside)
    tree = BoxTree(table.points[home], LEAF_WORDS)
    found = []
    for searches, points, down in ((same, table.points, 1), (longer, table.longer(), 0)):
        asking = np.flatnonzero(inside | searches)
        for leaf, rows in tree.reached(points[asking], 1, down):
            members = home[tree.members[leaf]]
            step = max(1, STEP_CELLS // (len(members) * (LETTERS + 1)))
            for k in range(0, len(rows), step):
                asks = asking[rows[k:k + step]]
                gap = table.points[members][None] - points[asks][:, None]
                near = (np.maximum(gap, 0).sum(axis=2) <= 1) & (np.maximum(-gap, 0).sum(axis=2) <= down)
                if down:  # a pair of words that both lie here is met from both ends
                    near &= ~inside[asks][:, None] | (asks[:, None] < members[None])
                x, y = np.nonzero(near)
                a, b = asks[x], members[y]
                # Clipped points of endless words may meet though their lengths don't fit.
                fits = table.length[b] - table.length[a] == (0 if down else 1)
                a, b = a[fits], b[fits]
                close = one_edit_apart(table, a, b)
                found.append(np.stack((a[close], b[close])))
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, near, near_n) for both words of each pair one edit apart, each once.

    ``words`` (word, n) has each word once and is read several times. Words of one shape beyond what a
    shard takes (same counts of all letters) stay together; their pairs are compared block by block.
    """
    size = words.count()
    shards = min(MAX_SHARDS, max(1, -(-size // shard_words)))
    below = int(min(1.0, SAMPLE_PER_SHARD * shards / max(1, size)) * (1 << 63))
    picked = words.where(F.xxhash64("word").bitwiseAND((1 << 63) - 1) <= below - 1).select("word").toArrow().column("word")
    boxes = words.sparkSession.sparkContext.broadcast(  # some 200 bytes a shard
        vars(BoxTree(WordTable(picked).points, max(1, -(-len(picked) // shards)), whole=True)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = revived(BoxTree, boxes.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            table = WordTable(batch.column("word"))
            own = tree.own_leaf(table.points)
            sent = [(np.arange(len(own)), own, 0)]
            # Of two shards that hold words of one length, the first one's visit the other.
            sent += [(rows[own[rows] < leaf], leaf, 1) for leaf, rows in tree.reached(table.points, 1, 1)]
            sent += [(rows[own[rows] != leaf], leaf, 2) for leaf, rows in tree.reached(table.longer(), 1, 0)]
            for rows, leaf, role in sent:
                if len(rows):
                    yield pa.RecordBatch.from_pydict({
                        "shard": np.broadcast_to(leaf, len(rows)).astype(np.int32), "role": np.full(len(rows), role, np.int32),
                        "word": batch.column("word").take(pa.array(rows)), "n": batch.column("n").take(pa.array(rows)),
                    })

    def compare(shard: pa.Table) -> pa.Table:
        role = shard.column("role").to_numpy()
        a, b = near_pairs(shard.column("word"), role == 0, role == 1, role == 2)
        one, other = pa.array(np.concatenate((a, b))), pa.array(np.concatenate((b, a)))
        return pa.table({
            "word": shard.column("word").take(one), "near": shard.column("word").take(other), "near_n": shard.column("n").take(other)})

    sent = words.select("word", "n").mapInArrow(route, "shard int, role int, word string, n long")
    return sent.groupBy("shard").applyInArrow(compare, "word string, near string, near_n long")


# ---- forms and roots ---------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where following the forms ends. A form is more frequent
    than its word by a factor, so chains are short and have no rings; each round doubles the steps."""
    reached = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = checkpointed(reached.join(on, "root", "left"))
        reached = further.select("word", F.coalesce("further", "root").alias("root"))
        if further.where(F.col("further").isNotNull()).isEmpty():
            return reached


def spelling_variants(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word with enough letters that occurs often enough.

    Null text has no words; a null id counts as empty text in the hash that picks runs. Repeated
    rows count each. Of near words equally frequent the smallest in code-point order is the form. An
    empty table gives no row. Only the named columns are read.
    """
    words = written(word_counts(docs, id_col, text_col), "spelling-words")
    near = near_words(words, shard_words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("top"))
    found = written(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(-F.col("top.minus") >= FORM_RATIO * F.col("n"), F.struct(F.col("top.near").alias("form"), (-F.col("top.minus")).alias("form_n"))).alias("f"),
        ).select("word", "f.form", "n", "n_near", "f.form_n"),
        "spelling-forms")
    ends = roots(found.where(F.col("form").isNotNull()).select("word", "form"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

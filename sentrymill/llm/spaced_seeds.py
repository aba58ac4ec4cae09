"""Benchmark decontamination by spaced seeds.

A mask is a fixed pattern of word places; the words between them are ignored, so a seed
still matches where one of those was replaced. Seeds of the benchmark items are indexed by
hash, training texts look theirs up, and around each hit the item is laid against the text
word by word: substitutions cost nothing but their own place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import ALNUM_TABLE, Words, revived, runs, steps, windows, written

# With these two, every 15 words of which at most 3 are replaced share a seed (tested over all
# choices of the 3).
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 5))
# A third one for items under so many words: two replaced words can break both masks in 10 or 11
# words. With it no layout of a short item is lost (tested over all).
SHORT_ITEM_WORDS = 12
SHORT_MASKS = ((0, 1, 3, 6, 7),)
# At least this share of the aligned words must be equal ...
SHARE = (4, 5)
# ... and so many of them, or that share of the item where that is less.
MATCHED_WORDS = 12
# Items with fewer words can't be told from common phrases and match nothing.
ITEM_WORDS = 8
# Words of benchmark items that are indexed and broadcast at a time; larger benchmarks take
# several passes over the documents.
CHUNK_WORDS = 250_000

# Words compared at a time.
STEP_WORDS = 1 << 20

PAIRS = "doc_id long, item_id long, matched_words int, aligned_words int, item_words int, first_word int"


class SeedIndex:
    """Seeds and words of a bounded number of benchmark items."""

    def __init__(self, item_ids: list, texts: list[str | None], masks=MASKS, short_masks=SHORT_MASKS):
        self.masks = []
        self.item_null = np.array([i is None for i in item_ids])
        self.item_ids = np.array([i or 0 for i in item_ids], np.int64)
        w = Words(pa.array(texts, pa.large_string()), ALNUM_TABLE)
        self.words, self.first = w.hashes(), w.first
        seeds, entries = [], []
        for k, mask in enumerate((*masks, *short_masks)):
            s, at = _seeds(self.words, self.first, mask, k)
            item = np.searchsorted(self.first, at, side="right") - 1
            size = np.diff(self.first)[item]
            fit = (size >= ITEM_WORDS) & ((size < SHORT_ITEM_WORDS) | (k < len(masks)))
            if fit.any():
                self.masks.append((k, mask))
            seeds.append(s[fit])
            entries.append(np.stack((item[fit], (at - self.first[item])[fit]), 1))
        seeds, entries = np.concatenate(seeds), np.concatenate(entries)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.entries = seeds[order], entries[order]
        bits = int(np.clip(np.ceil(np.log2(16 * len(seeds) + 1)), 16, 26))
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[self.seeds >> self.shift] = True

    def search(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """The best alignment of each (text, item) that overlap enough, by text, then item."""
        w = Words(texts, ALNUM_TABLE)
        h = w.hashes()
        found = [np.zeros((0, 3), np.int64)]
        for k, mask in self.masks:
            s = windows(h, mask) + np.uint64(k)
            at = np.flatnonzero(self.filter[s >> self.shift])
            doc = np.searchsorted(w.first, at, side="right") - 1
            at = at[at + mask[-1] < w.first[doc + 1]]
            low, high = np.searchsorted(self.seeds, s[at]), np.searchsorted(self.seeds, s[at], side="right")
            at, entry = np.repeat(at, high - low), np.repeat(low, high - low) + runs(high - low)
            doc = np.searchsorted(w.first, at, side="right") - 1
            item, offset = self.entries[entry].T
            found.append(np.stack((doc, item, at - w.first[doc] - offset), 1))
        best: dict[tuple[int, int], tuple] = {}
        aligned = np.concatenate(found)
        aligned = aligned[np.lexsort(aligned.T[::-1])]
        aligned = aligned[(np.diff(aligned, axis=0, prepend=-1 - abs(aligned[:1])) != 0).any(axis=1)]
        for doc, item, shift in aligned[self._equal_enough(aligned, w, h)].tolist():
            own = self.words[self.first[item]:self.first[item + 1]]
            text = h[w.first[doc]:w.first[doc + 1]]
            a, b = max(0, -shift), min(len(own), len(text) - shift)
            matched, i, j = best_segment(own[a:b] == text[a + shift:b + shift])
            if matched >= min(MATCHED_WORDS, -(-SHARE[0] * len(own) // SHARE[1])):
                row = (-matched, i + a + shift, j - i, len(own))
                if row < best.get((doc, item), (1,)):
                    best[doc, item] = row
        keys = sorted(best)
        column = lambda k: np.array([best[x][k] for x in keys], np.int32)
        return {
            "doc": np.array([d for d, _ in keys], np.int64), "item": np.array([i for _, i in keys], np.int64),
            "matched_words": -column(0), "first_word": column(1), "aligned_words": column(2), "item_words": column(3),
        }

    def _equal_enough(self, aligned: np.ndarray, w: Words, h: np.ndarray) -> np.ndarray:
        """Which (text, item, shift) have as many equal words in all as a hit needs."""
        doc, item, shift = aligned.T
        own, text = np.diff(self.first)[item], w.counts[doc]
        start = np.maximum(0, -shift)
        size = np.minimum(own, text - shift) - start
        out = np.zeros(len(aligned), bool)
        step = np.cumsum(size) // STEP_WORDS
        for rows in np.split(np.arange(len(aligned)), np.flatnonzero(np.diff(step)) + 1):
            if len(rows):
                n, k = size[rows], runs(size[rows])
                a = np.repeat(self.first[item[rows]] + start[rows], n) + k
                b = np.repeat(w.first[doc[rows]] + start[rows] + shift[rows], n) + k
                equal = np.concatenate(([0], np.cumsum(self.words[a] == h[b])))
                ends = np.cumsum(n)
                need = np.minimum(MATCHED_WORDS, -(-SHARE[0] * own[rows] // SHARE[1]))
                out[rows] = equal[ends] - equal[ends - n] >= need
        return out


def _seeds(words: np.ndarray, first: np.ndarray, mask, k: int) -> tuple[np.ndarray, np.ndarray]:
    s = windows(words, mask) + np.uint64(k)
    at = np.arange(len(s))
    inside = at + mask[-1] < first[np.searchsorted(first, at, side="right")] if len(s) else np.zeros(0, bool)
    return s[inside], at[inside]


def best_segment(equal: np.ndarray) -> tuple[int, int, int]:
    """Most equal places in a stretch i:j of which the wanted share is equal, and that stretch.

    The first such stretch by its end, from an equal place to an equal place.
    """
    num, den = SHARE
    gain = np.concatenate(([0], np.cumsum(np.where(equal, den - num, -num))))
    hits = np.concatenate(([0], np.cumsum(equal)))
    start = np.searchsorted(-np.minimum.accumulate(gain), -gain)  # the earliest place not above each
    matched = hits - hits[start]
    j = int(matched.argmax())
    i = int(start[j])
    inside = np.flatnonzero(equal[i:j])
    return (int(matched[j]), i + int(inside[0]), i + int(inside[-1]) + 1) if len(inside) else (0, 0, 0)


def _indexes(bench: DataFrame, id_col: str, text_col: str, chunk_words: int) -> Iterator[SeedIndex]:
    """The distinct items, a bounded number of words at a time."""
    ids, texts, words = [], [], 0
    rows = bench.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).distinct()
    for row in rows.toLocalIterator():
        ids.append(row.i)
        texts.append(row.t)
        words += len((row.t or "").encode().translate(ALNUM_TABLE).split())
        if words >= chunk_words:
            yield SeedIndex(ids, texts)
            ids, texts, words = [], [], 0
    if ids:
        yield SeedIndex(ids, texts)


def benchmark_overlaps(
    docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """One row per document row and benchmark item that overlap: the best alignment's figures.

    A hit counts when a stretch of the item laid against the text has at least four in five
    words equal, and ``MATCHED_WORDS`` of them (or four fifths of a shorter item). Words are
    runs of digits, a-z and non-ASCII after lower-casing A-Z. Null and empty texts, and items
    under ``ITEM_WORDS`` words, overlap nothing; repeated items count once, repeated documents
    each. Documents are never shuffled, so no passage or source makes a hot key.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark, out = docs.sparkSession, None
    for index in _indexes(bench, item_id_col, item_text_col, chunk_words):
        shared = spark.sparkContext.broadcast(vars(index))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = revived(SeedIndex, shared.value)
            for batch in steps(batches, "text"):
                hit = index.search(batch.column("text"))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").take(pa.array(hit["doc"])),
                    "item_id": pa.array(index.item_ids[hit["item"]], mask=index.item_null[hit["item"]]),
                    **{c: hit[c] for c in ("matched_words", "aligned_words", "item_words", "first_word")},
                })

        found = docs.mapInArrow(search, PAIRS)
        if out is not None:  # more than one pass: keep what was found and free its index
            found = written(found, "seed-hits")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], PAIRS) if out is None else out


def drop_contaminated(
    docs: DataFrame, bench: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """``docs`` without the rows that overlap any benchmark item, as ``benchmark_overlaps`` defines it."""
    sc, schema = docs.sparkSession.sparkContext, docs.schema
    for k, index in enumerate(_indexes(bench, item_id_col, item_text_col, chunk_words)):
        if k:
            docs = written(docs, "seed-kept")
        shared = sc.broadcast(vars(index))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = revived(SeedIndex, shared.value)
            for batch in steps(batches, text_col):
                keep = np.ones(batch.num_rows, bool)
                keep[index.search(batch.column(text_col))["doc"]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, schema)
    return docs

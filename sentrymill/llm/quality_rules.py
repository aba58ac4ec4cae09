"""Quality rules: hard limits, then a likelihood ratio of hashed n-grams.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials are counted,
one over the documents that are labelled good (the target), one over the whole corpus. A
document's score is the mean over its n-grams of log p_target - log p_corpus; the one
threshold holds for every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import SAME_TABLE, SPACES, Words, mix, span_hashes, steps, windows

BUCKETS = 1 << 14
SMOOTHING = 1.0
THRESHOLD = -0.08
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"


def ngrams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each word and each pair of neighbouring words."""
    h, doc = w.hashes(), w.doc
    pair = windows(h, range(2))
    inside = doc[1:] == doc[:-1]
    buckets = np.concatenate((h, pair[inside])) >> np.uint64(64 - (BUCKETS.bit_length() - 1))
    return buckets.astype(np.int64), np.concatenate((doc, doc[1:][inside]))


def base_figures(w: Words, raw: np.ndarray) -> dict[str, np.ndarray]:
    """The counts that the hard limits use, per text; ``raw`` is the words' own bytes."""
    n_docs, doc = len(w.counts), w.doc

    def per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[ends])

    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {
        "n_words": w.counts,
        "word_chars": per_text(~space[raw] & ((raw & 0xC0) != 0x80), w.ends),
        "n_symbols": per_text(symbol[raw], w.ends),
    }
    # lines with a word that an earlier line of the text equals
    starts = np.unique(np.concatenate((w.ends[:-1], np.flatnonzero(raw == 10) + 1)))
    starts = starts[starts < len(raw)]
    stops = np.append(starts[1:], len(raw))[:len(starts)]
    stops = stops - (raw[stops - 1] == 10)
    words = np.diff(np.searchsorted(w.start, np.append(starts, len(raw))))
    full = words > 0
    line_doc = np.searchsorted(w.ends, starts[full], side="right") - 1
    key = span_hashes(raw, starts[full], stops[full]) + mix(line_doc.astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n_docs)
    # words in windows that the text has twice
    n = max(0, len(w) - REPEAT_WINDOW + 1)
    h = windows(w.hashes(), range(REPEAT_WINDOW))
    at = np.flatnonzero(doc[:n] == doc[REPEAT_WINDOW - 1:]) if n else np.zeros(0, int)
    _, inverse, count = np.unique(h[at] + mix(doc[at].astype(np.uint64)), return_inverse=True, return_counts=True)
    at = at[count[inverse] > 1]
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = per_text(np.cumsum(edge)[:-1] > 0, w.first)
    return out


def _words(column: pa.Array) -> Words:
    return Words(column, SAME_TABLE, SPACES)


def ngram_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the column ``text``: one partial vector per task, then a sum."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in steps(batches, "text"):
            total += np.bincount(ngrams(_words(batch.column("text")))[0], minlength=BUCKETS)
        bucket = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": bucket.astype(np.int32), "n": total[bucket]})

    rows = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = rows.toArrow()  # as many rows as there are buckets, at most
    out = np.zeros(BUCKETS)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def log_ratios(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    p, q = target + SMOOTHING, corpus + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Log ratio of each bucket, from every document and from every one that has a label 1.

    Without any such document all ratios are 0, so that every score is 0.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("id"))
    # labels grow with the documents, so their join is planned as one of two large tables
    target = ngram_counts(rows.join(good.hint("merge"), "id", "left_semi"))
    return log_ratios(target, ngram_counts(rows)) if target.any() else np.zeros(BUCKETS)


def judged(docs: DataFrame, ratios: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The base figures, base_failed, score and kept of every row. Null text counts as empty; a text without words scores 0."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            w = _words(batch.column("text"))
            figures = base_figures(w, w.data)
            buckets, doc = ngrams(w)
            n = np.bincount(doc, minlength=batch.num_rows)
            score = np.bincount(doc, weights=ratios[buckets], minlength=batch.num_rows) / np.maximum(n, 1)
            failed = (figures["n_words"] < MIN_WORDS) | (100 * figures["n_repeat_words"] > MAX_REPEAT_PERCENT * figures["n_words"])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), **{k: v.astype(np.int64) for k, v in figures.items()},
                "base_failed": failed, "score": score, "kept": ~failed & (score >= threshold),
            })

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(judge, (
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, score double, kept boolean"))

"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features describe it and the lines before and after it; the
chain couples labels of neighbouring lines. Forward-backward gives each line's chance of being
good; their mean, weighted by line length and calibrated, is the document's score. Lines
inherit the label of their document in training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import SAME_TABLE, SPACES, Words, mix, remainder, runs, steps

HELD_OUT = (5, 0)  # labels of rows whose crc32(id) has this remainder are never learned from
THRESHOLD = 0.3
# Labelled documents the model is fitted on, at most about (picked by hash); every document is scored.
TRAINING_ROWS = 4000
ROUNDS, RATE, DECAY = 160, 0.1, 1e-3

_CLASSES = {
    "upper": bytes(range(65, 91)), "symbol": b"#*$%&|<>!", "digit": bytes(range(48, 58)),
    "letter": bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)),
}
# Own features that the lines before and after also contribute.
_NEAR = ("words", "upper", "symbol", "repeat")


class Lines:
    """Features of all lines with a word, text by text; a text without any has one empty line."""

    def __init__(self, texts: pa.Array):
        w = Words(texts, SAME_TABLE, SPACES)
        n_docs, data = len(w.counts), w.data
        cuts = np.unique(np.concatenate((w.ends[:-1], np.flatnonzero(data == 10) + 1)))
        cuts = np.append(cuts[cuts < len(data)], len(data))
        at = np.searchsorted(w.start, cuts)
        full = np.flatnonzero(np.diff(at))
        a, b = cuts[full], cuts[full + 1]
        doc = np.searchsorted(w.ends, a, side="right") - 1
        words = np.diff(at)[full].astype(float)
        size = (w.end[at[full + 1] - 1] - w.start[at[full]]).astype(float)

        share = {}
        for name, members in _CLASSES.items():
            flags = np.zeros(256, np.int32)
            flags[list(members)] = 1
            sums = np.concatenate(([0], np.cumsum(flags[data])))
            share[name] = (sums[b] - sums[a]) / size
        h = w.hashes()
        again = np.zeros(len(w) + 1)
        same = np.zeros(len(w), bool)
        place_in_text = runs(w.counts)
        same[1:] = (h[1:] == h[:-1]) & (place_in_text[1:] > 0)
        same[2:] |= (h[2:] == h[:-2]) & (place_in_text[2:] > 1)
        again[1:] = np.cumsum(same)
        repeat = (again[at[full + 1]] - again[at[full]]) / words
        key = np.zeros(0, np.uint64)
        if len(full):  # a hash of each line's words in their order
            place = runs(words.astype(np.int64)).astype(np.uint64)
            key = mix(np.add.reduceat(h * (np.uint64(2) * place + np.uint64(1)), at[full]))
        _, first = np.unique(key + mix(doc.astype(np.uint64)), return_index=True)
        repeated = np.ones(len(full))
        repeated[first] = 0
        lengths = np.bincount(doc, minlength=n_docs)
        own = {
            "words": np.log1p(words), "word_size": size / words, **share, "repeat": repeat, "repeated": repeated,
            "doc_words": np.log1p(w.counts)[doc], "doc_few": np.minimum(w.counts, 40)[doc] / 40.0,
            "doc_lines": np.log1p(lengths)[doc],
        }
        head = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
        tail = np.append(head[1:], True) if len(doc) else head
        for name in _NEAR:
            own[f"{name}_before"] = np.where(head, 0, np.roll(own[name], 1))
            own[f"{name}_after"] = np.where(tail, 0, np.roll(own[name], -1))
        own |= {"head": head.astype(float), "tail": tail.astype(float), "one": np.ones(len(doc))}
        x = np.stack(list(own.values()), 1) if len(doc) else np.zeros((0, len(own)))
        # one line of nothing but the constant for texts without lines
        slot = np.arange(len(doc)) + np.concatenate(([0], np.cumsum(lengths == 0)))[doc] if len(doc) else np.zeros(0, int)
        self.count = np.maximum(lengths, 1)
        self.x = np.zeros((int(self.count.sum()), len(own)))
        self.x[:, -1] = 1
        self.x[slot] = x
        self.size = np.ones(len(self.x))
        self.size[slot] = size


    @classmethod
    def of(cls, texts: pa.Array) -> Lines:
        """As the constructor, with a step's memory at a time."""
        parts = [cls(b.column("text")) for b in steps([pa.RecordBatch.from_arrays([texts], ["text"])], "text")]
        whole = parts[0] if parts else cls(texts)
        for name in ("x", "size", "count"):
            setattr(whole, name, np.concatenate([getattr(p, name) for p in parts or [whole]]))
        return whole


class Chains:
    """Forward-backward over many chains of two labels, position by position for all at once."""

    def __init__(self, count: np.ndarray):
        self.count, self.first = count, np.cumsum(count) - count
        self.order = np.argsort(-count, kind="stable")
        self.doc = np.repeat(np.arange(len(count)), count)
        ranked = count[self.order]
        self.active = np.searchsorted(-ranked, -np.arange(1, (ranked[0] if len(ranked) else 0) + 1), side="right")

    def run(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log forward and backward scores of both labels of each line, and each chain's log total."""
        u = np.stack((np.zeros(len(unary)), unary), 1)
        alpha, beta = u.copy(), np.zeros_like(u)
        for t, m in enumerate(self.active):
            if t:
                i = self.first[self.order[:m]] + t
                before = alpha[i - 1]
                alpha[i] += np.logaddexp(before[:, :1] + pair[0], before[:, 1:] + pair[1])
        for t in range(len(self.active) - 1, 0, -1):
            i = self.first[self.order[:self.active[t]]] + t
            after = beta[i] + u[i]
            beta[i - 1] = np.logaddexp(pair[:, 0] + after[:, :1], pair[:, 1] + after[:, 1:])
        last = self.first + self.count - 1
        return alpha, beta, np.logaddexp(alpha[last, 0], alpha[last, 1])


class LineCrf:
    """Weights of the line features, of neighbouring label pairs, and the calibration of the mean."""

    def __init__(self, features: int):
        self.mean, self.scale = np.zeros(features), np.ones(features)
        self.weight, self.pair, self.line = np.zeros(features), np.zeros((2, 2)), (1.0, 0.0)

    def _marginals(self, lines: Lines) -> tuple[np.ndarray, Chains]:
        chains = Chains(lines.count)
        alpha, beta, total = chains.run(((lines.x - self.mean) / self.scale) @ self.weight, self.pair)
        return np.exp(np.minimum(0.0, alpha[:, 1] + beta[:, 1] - total[chains.doc])), chains

    def _means(self, lines: Lines) -> np.ndarray:
        p, chains = self._marginals(lines)
        good, size = np.add.reduceat(p * lines.size, chains.first), np.add.reduceat(lines.size, chains.first)
        return good / size

    def score(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        if not self.weight.any():
            return np.full(len(texts), 0.5)
        z = self.line[0] * _logit(self._means(Lines(texts))) + self.line[1]
        return 1 / (1 + np.exp(-z))

    @classmethod
    def fit(cls, texts: pa.Array, labels: np.ndarray) -> LineCrf:
        """Maximum likelihood of the line labels, each document counting once, with weight decay."""
        lines = Lines.of(texts)
        model = cls(lines.x.shape[1])
        if len(set(labels.tolist())) < 2:
            return model
        model.mean, model.scale = lines.x.mean(0), lines.x.std(0) + 1e-6
        model.mean[-1], model.scale[-1] = 0, 1
        x, chains = (lines.x - model.mean) / model.scale, Chains(lines.count)
        doc, y = chains.doc, labels.astype(int)
        heft = 1 / lines.count[doc] / len(labels)
        rest = np.setdiff1d(np.arange(len(x)), chains.first)
        target = np.zeros((2, 2))
        np.add.at(target, (y[doc[rest]], y[doc[rest]]), heft[rest])
        params, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
        for k in range(1, ROUNDS + 1):
            pair = params[-4:].reshape(2, 2)
            unary = x @ params[:-4]
            alpha, beta, total = chains.run(unary, pair)
            p = np.exp(np.minimum(0.0, alpha[:, 1] + beta[:, 1] - total[doc]))
            u = np.stack((np.zeros(len(unary)), unary), 1)
            both = alpha[rest - 1][:, :, None] + pair + (u[rest] + beta[rest])[:, None, :] - total[doc[rest], None, None]
            expected = (np.exp(np.minimum(0.0, both)) * heft[rest, None, None]).sum(0)
            grad = np.concatenate(((heft * (y[doc] - p)) @ x, (target - expected).ravel())) - DECAY * params
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            params = params + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        model.weight, model.pair = params[:-4], params[-4:].reshape(2, 2)
        model.line = _calibrate(_logit(model._means(lines)), y)
        return model


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a weak pull to slope 1."""
    w = np.array([1.0, 0.0])
    design = np.stack((z, np.ones(len(z))), 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        grad = design.T @ (y - p) - 0.1 * (w - [1, 0])
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        w = w + np.linalg.solve(hess, grad)
    return float(w[0]), float(w[1])


# ---- Spark -------------------------------------------------------------------------------


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    training_rows: int = TRAINING_ROWS, held_out: tuple[int, int] = HELD_OUT,
) -> LineCrf:
    """Fit on at most about ``training_rows`` labelled documents that aren't held out, picked by a hash of the id.

    Labels are 1 or 0; null ids and other labels are left out, and of several labels of an id the
    smallest counts, as does the smallest text of several rows of an id. Without both labels the model gives every text 0.5.
    """
    usable = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.min(label_col).cast("int").alias("y")).where("id IS NOT NULL")
    usable = usable.where(F.crc32(F.encode(F.col("id").cast("string"), "UTF-8")) % held_out[0] != held_out[1])
    n = usable.count()
    below = int(min(1.0, training_rows / max(1, n)) * (1 << 62)) * 2 - 1
    picked = usable.where(F.xxhash64("id").bitwiseAND((1 << 63) - 1) <= below)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # one row per picked id, so what comes to the driver is bounded where ids repeat
    found = rows.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text")).toArrow()
    order = sorted(range(found.num_rows), key=lambda k, i=found.column("id").to_pylist(), t=found.column("text").to_pylist(): (i[k], t[k] or ""))
    found = found.take(pa.array(order, pa.int64()))
    return LineCrf.fit(found.column("text").combine_chunks(), found.column("y").to_numpy())


def scored(docs: DataFrame, model: LineCrf, *, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score and predicted per row. Null text counts as empty; only text is scored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            score = model.score(batch.column("text"))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "held_out": [remainder(k, held_out[0]) == held_out[1] for k in batch.column("key").to_pylist()],
                "score": score, "predicted": (score >= THRESHOLD).astype(np.int32),
            })

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: LineCrf, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_col):
            yield batch.filter(pa.array(model.score(batch.column(text_col)) >= threshold))

    return docs.mapInArrow(run, docs.schema)

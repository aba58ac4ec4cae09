"""Language-model scores from a gated recurrent network, trained here on the corpus.

Words are counted over all training documents. The most frequent ones are the network's own
words, in classes of equal size; all others fall into classes by their shape. A word's
probability is that of its class given the state, times its own within the class: a second
softmax for the network's words, its smoothed share of the class's count for the others. So
the two softmaxes stay small, every word has a probability, and they sum to one.

Training is data-parallel: a hash deals the training documents to rounds and shards, whose number
grows with the corpus. In each round every shard trains on its documents in the order of their hash, from the
same weights and the same state of the optimiser, and the results are averaged by token counts. So how
the table is split into files and tasks changes nothing. Rows equal in id and text go to one shard.
Backpropagation is cut after ``WINDOW`` words; the state goes on from window to window. In scoring
it goes on to the end of a document; in training also a lane's edge ends it, as a shard's tokens
are cut into up to ``TRAIN_LANES`` even lanes wherever an edge falls.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import LOWER_TABLE, SPACES, Words, remainder, revived, steps, written

HELD_OUT = (7, 2)
UNITS = 16
CLASSES, CLASS_WORDS = 16, 32
SHAPES = 16
# Words whose counts every task holds, at most; the counts of the others are joined.
HEAD_WORDS = 1 << 19
TRAIN_ROUNDS = 3
# Training tokens aimed at per shard and round.
SHARD_TOKENS = 1 << 20
RATE = 0.01
WINDOW, TRAIN_LANES, SCORE_WINDOW, SCORE_LANES = 16, 512, 32, 512
# Words that a task counts, trains on or scores at a time (one longer document is alone).
CHUNK_WORDS = 2 << 20
END = np.uint64(0x656E64206F662074)  # stands for the end of a document


# ---- words -------------------------------------------------------------------------------


class Tokens:
    """Hash, shape class and document of each token of a run of texts; an end closes each."""

    def __init__(self, texts: pa.Array):
        w = Words(texts, LOWER_TABLE, SPACES)
        ends = w.first[1:]
        self.count = w.counts + 1
        self.hash = np.insert(w.hashes(), ends, END)
        size, last = w.end - w.start, w.data[w.end - 1] if len(w) else np.zeros(0, np.uint8)
        wide = np.concatenate(([0], np.cumsum(w.data >= 128, dtype=np.int32)))
        ending = np.where(last == 46, 1, np.where(last == 44, 2, np.where((last >= 128) | ((last >= 97) & (last <= 122)), 0, 3)))
        shape = ending * 4 + (wide[w.end] > wide[w.start]) * 2 + (size > 8)
        self.shape = np.insert(shape, ends, 0).astype(np.int8)

    def cut(self, a: int, b: int) -> Tokens:
        """Those of texts a to b."""
        out = Tokens.__new__(Tokens)
        at = np.concatenate(([0], np.cumsum(self.count)))
        out.count, out.hash, out.shape = self.count[a:b], self.hash[at[a]:at[b]], self.shape[at[a]:at[b]]
        return out


@dataclass
class Vocabulary:
    """What every task knows of the counts: bounded in size."""

    hashes: np.ndarray  # of the head words, ascending
    counts: np.ndarray
    slots: np.ndarray  # the network's own words by rank; -1 for others
    n: int  # training tokens
    distinct: int
    shape_n: np.ndarray  # tokens and distinct words of each shape class, the network's words left out
    shape_v: np.ndarray

    def __post_init__(self):
        self.bits = max(1, int(np.ceil(np.log2(len(self.hashes) + 1))))
        edge = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.index = np.append(np.searchsorted(self.hashes, edge), len(self.hashes))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the head words, or -1."""
        out = np.full(len(h), -1, np.int64)
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.index[top], self.index[top + 1]
        rest = np.flatnonzero(at < stop)
        while len(rest):
            here = at[rest]
            hit = self.hashes[here] == h[rest]
            out[rest[hit]] = here[hit]
            at[rest] += 1
            rest = rest[~hit & (at[rest] < stop[rest])]
        return out


# ---- the network -------------------------------------------------------------------------


class Lanes:
    """Documents side by side: each lane reads its documents one after the other.

    Long documents are dealt first, each to the lane with the least to read; lanes are in
    falling order of length, so those still reading are always the first ones.
    """

    def __init__(self, count: np.ndarray, lanes: int):
        first = np.cumsum(count) - count
        lanes = max(1, min(lanes, len(count)))
        load = [(0, k) for k in range(lanes)]
        of: list[list[int]] = [[] for _ in range(lanes)]
        for d in np.argsort(-count, kind="stable").tolist():
            n, k = heapq.heappop(load)
            of[k].append(d)
            heapq.heappush(load, (n + int(count[d]), k))
        load = sorted(((-n, k) for n, k in load))
        docs = [d for _, k in load for d in of[k]]
        self.length = np.array([-n for n, _ in load])
        self.start = np.cumsum(self.length) - self.length
        size = count[docs] if docs else np.zeros(0, np.int64)
        self.order = np.repeat(first[docs], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)

    @classmethod
    def even(cls, n: int, lanes: int) -> Lanes:
        """Lanes of equal length over ``n`` tokens in a row; a document may go on in the next lane."""
        out = cls.__new__(cls)
        lanes = max(1, min(lanes, n // WINDOW))
        edges = np.linspace(0, n, lanes + 1).astype(np.int64)
        size = np.diff(edges)
        longest = np.argsort(-size, kind="stable")
        out.length, out.start, out.order = size[longest], edges[:-1][longest], np.arange(n)
        return out

    def windows(self, steps_: int) -> Iterator[list[np.ndarray]]:
        """Lists of steps; each step has the token places of the lanes that still read."""
        longest = int(self.length[0]) if len(self.length) else 0
        for t in range(0, longest, steps_):
            yield [self.order[self.start[:m] + k] for k in range(t, min(t + steps_, longest))
                   if (m := int(np.searchsorted(-self.length, -k)))]


class Gru:
    """Weights: input table, recurrence, class softmax, and a softmax within each word class."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    @classmethod
    def fresh(cls, slot_counts: np.ndarray, shape_n: np.ndarray) -> Gru:
        """Small random weights; output biases make it the unigram model to start with."""
        rng = np.random.default_rng(11)
        own = CLASSES * CLASS_WORDS
        normal = lambda *s: (rng.normal(size=s) * 0.1).astype(np.float32)
        word = np.full(own, -1e9, np.float32)
        word[:len(slot_counts)] = np.log(slot_counts + 1.0)
        per_class = np.zeros(CLASSES)
        np.add.at(per_class, np.arange(len(slot_counts)) // CLASS_WORDS, slot_counts + 1.0)
        total = np.concatenate((per_class, shape_n + 1.0))
        bias = np.where(total > 0, np.log(np.maximum(total, 1e-9)), -1e9).astype(np.float32)
        bias -= np.log(np.exp(bias - bias.max()).sum()) + bias.max()
        return cls([
            normal(own + SHAPES + 1, 3 * UNITS), normal(UNITS, 3 * UNITS),
            normal(UNITS, CLASSES + SHAPES) * 0, bias, normal(CLASSES, UNITS, CLASS_WORDS) * 0, word.reshape(CLASSES, CLASS_WORDS)])

    def forward(self, inputs: list[np.ndarray], resets: list[np.ndarray], state: np.ndarray, keep: list | None = None):
        """States after each step, and the last state of every lane."""
        table, u = self.weights[:2]
        out = []
        for i, reset in zip(inputs, resets):
            h = state[:len(i)]
            h[reset] = 0
            x, a = table[i], h @ u
            gates = 0.5 + 0.5 * np.tanh(0.5 * (x[:, :2 * UNITS] + a[:, :2 * UNITS]))
            r, z = gates[:, :UNITS], gates[:, UNITS:]
            n = np.tanh(x[:, 2 * UNITS:] + r * a[:, 2 * UNITS:])
            new = n + z * (h - n)
            if keep is not None:
                keep.append((i, reset, h.copy(), r, z, n, a[:, 2 * UNITS:]))
            state[:len(i)] = new
            out.append(new)
        return out

    def log_probability(self, h: np.ndarray, code: np.ndarray, grads: list | None = None) -> np.ndarray:
        """Natural log of the class and, for the network's words, of the word in its class.

        With ``grads``, adds the gradients of the sum to the output weights and returns that of ``h`` too.
        """
        _, _, o, ob, w, wb = self.weights
        own = CLASSES * CLASS_WORDS
        kind = np.where(code < own, code // CLASS_WORDS, CLASSES + code - own)
        logits = h @ o + ob
        logits -= logits.max(1, keepdims=True)
        e = np.exp(logits)
        total = e.sum(1)
        at = np.arange(len(code))
        out = logits[at, kind] - np.log(total)
        if grads is not None:
            d = -e / total[:, None]
            d[at, kind] += 1
            grads[2] += h.T @ d
            grads[3] += d.sum(0)
            dh = d @ o.T
        mine = np.flatnonzero(code < own)
        mine = mine[np.argsort(kind[mine], kind="stable")]
        cuts = np.searchsorted(kind[mine], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            rows = mine[cuts[c]:cuts[c + 1]]
            if len(rows):
                hc, word = h[rows], code[rows] % CLASS_WORDS
                logits = hc @ w[c] + wb[c]
                logits -= logits.max(1, keepdims=True)
                e = np.exp(logits)
                total = e.sum(1)
                at = np.arange(len(rows))
                out[rows] += logits[at, word] - np.log(total)
                if grads is not None:
                    d = -e / total[:, None]
                    d[at, word] += 1
                    grads[4][c] += hc.T @ d
                    grads[5][c] += d.sum(0)
                    dh[rows] += d @ w[c].T
        return out if grads is None else (out, dh)

    def score(self, code: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Log probability of every token, the state carried through its document."""
        lanes = Lanes(count, SCORE_LANES)
        inputs, starts = _inputs(code, count)
        state = np.zeros((len(lanes.length), UNITS), np.float32)
        out = np.zeros(len(code))
        for window in lanes.windows(SCORE_WINDOW):
            h = self.forward([inputs[p] for p in window], [starts[p] for p in window], state)
            p = np.concatenate(window)
            out[p] = self.log_probability(np.concatenate(h), code[p])
        return out

    def train(self, code: np.ndarray, count: np.ndarray, memory: dict) -> None:
        """One pass over the documents, an Adam step after each window; ``memory`` goes on from call to call."""
        m = memory.setdefault("m", [np.zeros_like(w) for w in self.weights])
        v = memory.setdefault("v", [np.zeros_like(w) for w in self.weights])
        lanes = Lanes.even(len(code), TRAIN_LANES)
        inputs, starts = _inputs(code, count)
        inputs[lanes.start], starts[lanes.start] = CLASSES * CLASS_WORDS + SHAPES, True
        state = np.zeros((len(lanes.length), UNITS), np.float32)
        for window in lanes.windows(WINDOW):
            kept: list = []
            h = self.forward([inputs[p] for p in window], [starts[p] for p in window], state, kept)
            grads = [np.zeros_like(w) for w in self.weights]
            p = np.concatenate(window)
            _, dh = self.log_probability(np.concatenate(h), code[p], grads)
            self._back(kept, np.split(dh, np.cumsum([len(x) for x in h])[:-1]), grads)
            k = memory["k"] = memory.get("k", 0) + 1
            rate = np.float32(RATE * np.sqrt(1 - 0.99**k) / (1 - 0.9**k))
            for w, g, m_, v_ in zip(self.weights, grads, m, v):
                g *= np.float32(1 / len(p))
                m_ += np.float32(0.1) * (g - m_)
                v_ += np.float32(0.01) * (g * g - v_)
                w += rate * m_ / (np.sqrt(v_) + np.float32(1e-5))

    def _back(self, kept: list, dhs: list[np.ndarray], grads: list[np.ndarray]) -> None:
        u = self.weights[1]
        later = np.zeros((0, UNITS), np.float32)
        ids, dxs = [], []
        for (i, reset, h, r, z, n, an), dh in zip(reversed(kept), reversed(dhs)):
            dh[:len(later)] += later
            dn = dh * (1 - z) * (1 - n * n)
            dr = dn * an * r * (1 - r)
            dz = dh * (h - n) * z * (1 - z)
            da = np.concatenate((dr, dz, dn * r), 1)
            grads[1] += h.T @ da
            later = dh * z + da @ u.T
            later[reset] = 0
            ids.append(i)
            dxs.append(np.concatenate((dr, dz, dn), 1))
        ids, dxs = np.concatenate(ids), np.concatenate(dxs)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        grads[0][ids[first]] += np.add.reduceat(dxs[order], first, axis=0)


def _inputs(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the network reads before each token: the token before, or a mark at a document's start."""
    starts = np.zeros(len(code), bool)
    starts[np.cumsum(count) - count] = True
    inputs = np.roll(code, 1)
    inputs[starts] = CLASSES * CLASS_WORDS + SHAPES
    return inputs, starts


def codes(tokens: Tokens, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The network's code of each token (own word, or shape class), and its place among the head words."""
    place = vocabulary.find(tokens.hash)
    slot = np.where(place >= 0, vocabulary.slots[place], -1) if len(vocabulary.slots) else place
    return np.where(slot >= 0, slot, CLASSES * CLASS_WORDS + tokens.shape.astype(np.int64)), place


# ---- Spark -------------------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Tokens]]:
    """Documents and their tokens, about ``CHUNK_WORDS`` tokens at a time."""
    rows, parts, n = [], [], 0
    for batch in steps(batches, "text"):
        t = Tokens(batch.column("text"))
        rows.append(batch.drop_columns(["text"]))
        parts.append(t)
        n += len(t.hash)
        if n >= CHUNK_WORDS:
            yield _joined(rows, parts)
            rows, parts, n = [], [], 0
    if rows:
        yield _joined(rows, parts)


def _joined(rows: list, parts: list[Tokens]) -> tuple[pa.Table, Tokens]:
    return pa.Table.from_batches(rows), _whole(parts)


def _whole(parts: list[Tokens]) -> Tokens:
    whole = parts[0]
    for name in ("count", "hash", "shape"):
        setattr(whole, name, np.concatenate([getattr(p, name) for p in parts]))
    return whole


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, shape, c) of every distinct token; each task counts its chunks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _chunks(batches):
            h, first, n = np.unique(t.hash, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "shape": t.shape[first].astype(np.int32), "c": n})

    found = texts.select("text").mapInArrow(count, "h long, shape int, c long")
    return written(found.groupBy("h").agg(F.min("shape").alias("shape"), F.sum("c").alias("c")), "lm-counts")


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """The head: all words from a count on, as many as fit; and totals over all words."""
    level = F.floor(F.log2("c") * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect()
    room, lowest = HEAD_WORDS, None
    for x in levels:  # some hundred rows
        room -= x.words
        if room < 0:
            break
        lowest = x.level
    head = counts.where(level >= F.lit(lowest if lowest is not None else 1 << 30)).toArrow()
    h = head.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    h, c, shape = h[order], head.column("c").to_numpy()[order], head.column("shape").to_numpy()[order]
    ranked = np.lexsort((h, -c, h != END))[:CLASSES * CLASS_WORDS]  # the end first, then by count
    slots = np.full(len(h), -1, np.int64)
    slots[ranked] = np.arange(len(ranked))
    shape_n, shape_v = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    for x in counts.groupBy("shape").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        shape_n[x["shape"]], shape_v[x["shape"]] = x.n, x.v
    n, distinct = int(shape_n.sum()), int(shape_v.sum())
    np.subtract.at(shape_n, shape[ranked], c[ranked])
    np.subtract.at(shape_v, shape[ranked], 1)
    return Vocabulary(h, c, slots, n, distinct, shape_n, shape_v)


def _shard_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Tokens]]:
    """Tokens by shard, of rows sorted by it: whole documents, cut after about ``CHUNK_WORDS`` tokens of a shard.
    Where batches end doesn't matter."""
    held: list[Tokens] = []
    shard, n = None, 0
    for batch in steps(batches, "text"):
        of = batch.column("shard").to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(of)]))
        for a, b in zip(cuts, cuts[1:]):
            if held and of[a] != shard:
                yield shard, _whole(held)
                held, n = [], 0
            shard = of[a]
            t = Tokens(batch.column("text").slice(int(a), int(b - a)))
            held.append(t)
            n += len(t.hash)
            while n >= CHUNK_WORDS:
                whole = _whole(held)
                docs = int(np.searchsorted(np.cumsum(whole.count), CHUNK_WORDS)) + 1
                yield shard, whole.cut(0, docs)
                rest = whole.cut(docs, len(whole.count))
                held, n = ([rest] if len(rest.count) else []), len(rest.hash)
    if held:
        yield shard, _whole(held)


def train(rows: DataFrame, vocabulary: Vocabulary) -> Gru:
    """Train on all of ``rows`` (h, text), a part by the hash ``h`` in each round."""
    sc = rows.sparkSession.sparkContext
    known = sc.broadcast(vars(vocabulary))
    slot_counts = vocabulary.counts[np.argsort(np.where(vocabulary.slots >= 0, vocabulary.slots, 1 << 40), kind="stable")]
    model = Gru.fresh(slot_counts[:int((vocabulary.slots >= 0).sum())], vocabulary.shape_n)
    memory = {"m": [np.zeros_like(w) for w in model.weights], "v": [np.zeros_like(w) for w in model.weights], "k": 0}
    shapes = [w.shape for w in model.weights]
    ends = np.cumsum([int(np.prod(s)) for s in shapes * 3])
    n_shards = max(1, vocabulary.n // (TRAIN_ROUNDS * SHARD_TOKENS))
    part = F.pmod("h", F.lit(TRAIN_ROUNDS * n_shards))
    dealt = rows.select(
        F.pmod(part, F.lit(TRAIN_ROUNDS)).alias("round"), F.floor(part / TRAIN_ROUNDS).cast("int").alias("shard"), "h", "text")

    def pack(model: Gru, memory: dict) -> bytes:
        return np.concatenate([w.ravel() for w in (*model.weights, *memory["m"], *memory["v"])]).astype(np.float32).tobytes()

    def unpack(vector: np.ndarray, k: int) -> tuple[Gru, dict]:
        arrays = [x.reshape(s).astype(np.float32) for x, s in zip(np.split(vector, ends[:-1]), shapes * 3)]
        third = len(shapes)
        return Gru(arrays[:third]), {"m": arrays[third:2 * third], "v": arrays[2 * third:], "k": k}

    for k in range(TRAIN_ROUNDS):
        start = sc.broadcast((pack(model, memory), memory["k"]))

        def work(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            words = revived(Vocabulary, known.value)
            packed, before = start.value
            for shard, chunks in groupby(_shard_chunks(batches), lambda x: x[0]):
                own, memory = unpack(np.frombuffer(packed, np.float32), before)
                n = 0
                for _, t in chunks:
                    own.train(codes(t, words)[0], t.count, memory)
                    n += len(t.hash)
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([shard], pa.int32()), "n": [n], "k": [n * memory["k"]], "weights": pa.array([pack(own, memory)], pa.binary())})

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n, k, shard = 0.0, 0, 0, None
            for batch in batches:
                for own, m, steps_, w in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "k", "weights"))):
                    total, n, k = total + m * np.frombuffer(w, np.float32).astype(float), n + m, k + steps_
                    shard = own if shard is None else shard
            if n:
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([shard], pa.int32()), "n": [n], "k": [k],
                    "weights": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())})

        model_row = "shard int, n long, k long, weights binary"
        trained = (
            dealt.where(F.col("round") == k).repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "h")
            .select("shard", "text").mapInArrow(work, model_row)
        )
        # averaged in two steps, so that neither a task nor the driver takes in the models of all shards
        for parts in (math.isqrt(n_shards), 8):
            trained = trained.repartitionById(parts, F.pmod("shard", F.lit(parts))).sortWithinPartitions("shard").mapInArrow(average, model_row)
        sums = sorted(trained.collect(), key=lambda x: x.shard)  # 8 rows at most
        if sums:
            n = sum(x.n for x in sums)
            vector = sum(x.n * np.frombuffer(x.weights, np.float32).astype(float) for x in sums) / n
            model, memory = unpack(vector, round(sum(x.k for x in sums) / n))
    return model


SCORED = (
    "doc_id {kind}, row long, held_out boolean, n_tokens long, known long, base double, model double, tail array<long>"
)


def scored(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = HELD_OUT,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from the rows whose crc32(id as text) modulo ``held_out[0]`` isn't ``held_out[1]``.
    Tokens are words between white space, A-Z lower-cased, and an end; null text counts as
    empty. ``base_score``: add-one unigram log10 probability; ``score``: the network's. Without
    training rows every word is unknown. Repeated rows count, and are scored, each.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    crc = F.crc32(F.encode(F.coalesce("key", F.lit("")), "UTF-8"))
    learn = base.where(crc % held_out[0] != held_out[1])
    counts = word_counts(learn)
    vocabulary = vocabulary_of(counts)
    model = train(learn.select(F.xxhash64("key", "text").alias("h"), "text"), vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((vars(vocabulary), model.weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, weights = shared.value
        vocabulary = revived(Vocabulary, state)
        network = Gru(weights)
        own = CLASSES * CLASS_WORDS
        share = np.log10(vocabulary.shape_n + vocabulary.shape_v + 1.0)
        for table, t in _chunks(batches):
            code, place = codes(t, vocabulary)
            ends = np.cumsum(t.count)
            first = ends - t.count
            head = place >= 0
            log_count = np.where(head, np.log10(vocabulary.counts[place] + 1.0), 0.0) if len(vocabulary.counts) else np.zeros(len(place))
            other = code >= own
            gain = network.score(code, t.count) / np.log(10)
            gain += np.where(other, log_count - share[np.where(other, code - own, 0)], 0.0)
            per_doc = lambda x: np.add.reduceat(x, first)
            tail = np.flatnonzero(~head)
            at = np.searchsorted(tail, np.append(first, len(code))).astype(np.int32)
            yield from pa.Table.from_pydict({
                "doc_id": table.column("doc_id"), "row": table.column("row"),
                "held_out": [remainder(k, held_out[0]) == held_out[1] for k in table.column("key").to_pylist()],
                "n_tokens": t.count.astype(np.int64), "known": per_doc(head.astype(np.int64)),
                "base": per_doc(log_count) - t.count * np.log10(vocabulary.n + vocabulary.distinct + 1.0),
                "model": per_doc(gain),
                "tail": pa.ListArray.from_arrays(pa.array(at), pa.array(t.hash[tail].view(np.int64))),
            }).to_batches(max_chunksize=2000)

    rows = base.withColumn("row", F.monotonically_increasing_id())
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = written(rows.mapInArrow(score, SCORED.format(kind=kind)), "lm-rows")
    # counts of the words that tasks don't hold; an unknown one adds log10(0 + 1)
    rest = (
        rows.select("row", F.explode("tail").alias("h")).join(counts.select("h", "c"), "h")
        .groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("log"), F.count(F.lit(1)).alias("n"))
    )
    more, n = F.coalesce("log", F.lit(0.0)), F.coalesce("n", F.lit(0))
    return rows.drop("tail").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + n).alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))

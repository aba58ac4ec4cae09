import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sentrymill.llm import gru_lm as lm

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, row int, tail string, key string, score double, n int"


def tokens(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def brute(rows):
    c = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return sorted(((i, held(i), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n,
                    round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x)), 6)) for i, x in rows), key=repr)


def base_of(rows):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=repr)


ODD = [(1, None), (2, ""), (3, "The the THE fox"), (4, "unseen words here, é."), (None, "the fox"), (5, "w " * 30000), (9, "x" * 50000),
       (15, "held out? the fox"), (7, "same"), (7, "same"), (8, " \n\t"), *[(k, "the fox runs. the dog sleeps, the fox") for k in range(20, 60)]]


@pytest.mark.parametrize("head_words", [1 << 19, 3, 0])
def test_edge_cases(spark, head_words, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_WORDS", head_words)
    docs = spark.createDataFrame([(*r, 1, "t", "k", 0.5, 3) for r in ODD], DOCS)
    rows = lm.scored(docs).collect()
    assert base_of(rows) == brute(ODD)
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    same = [r.score for r in rows if r.doc_id == 7]
    assert same[0] == pytest.approx(same[1])


def test_empty_table_and_no_training_rows(spark):
    docs = spark.createDataFrame([(*r, 1, "t", "k", 0.5, 3) for r in ODD], DOCS)
    assert lm.scored(docs.limit(0)).collect() == []
    only = [(i, "a b") for i in range(100) if held(i)]
    rows = lm.scored(spark.createDataFrame(only, "doc_id long, text string")).collect()
    assert base_of(rows) == brute(only) and all(math.isfinite(r.score) for r in rows)


def random_model(rng):
    own = lm.CLASSES * lm.CLASS_WORDS
    u = lm.UNITS
    shapes = [(own + lm.SHAPES + 1, 3 * u), (u, 3 * u), (u, lm.CLASSES + lm.SHAPES), (lm.CLASSES + lm.SHAPES,), (lm.CLASSES, u, lm.CLASS_WORDS), (lm.CLASSES, lm.CLASS_WORDS)]
    return lm.Gru([rng.normal(size=s) * 0.5 for s in shapes])


def by_hand(model, code):
    """One document, one token at a time: log probabilities, and whether each step's sum to one."""
    table, u, o, ob, w, wb = model.weights
    n, own = lm.UNITS, lm.CLASSES * lm.CLASS_WORDS
    h, last, out, sums = np.zeros(n), own + lm.SHAPES, [], []
    for t in code:
        x, a = table[last], h @ u
        r, z = (1 / (1 + np.exp(-(x[k:k + n] + a[k:k + n]))) for k in (0, n))
        new = np.tanh(x[2 * n:] + r * a[2 * n:])
        h = (1 - z) * new + z * h
        kind = np.exp(h @ o + ob) / np.exp(h @ o + ob).sum()
        words = [kind[c] * np.exp(h @ w[c] + wb[c]) / np.exp(h @ w[c] + wb[c]).sum() for c in range(lm.CLASSES)]
        every = np.concatenate([*words, kind[lm.CLASSES:]])
        out.append(np.log(every[t]))
        sums.append(every.sum())
        last = t
    assert np.allclose(sums, 1)
    return out


@pytest.mark.parametrize("lanes,window", [(3, 2), (512, 32), (1, 5)])
def test_state_is_carried_through_whole_documents(lanes, window, monkeypatch):
    monkeypatch.setattr(lm, "SCORE_LANES", lanes)
    monkeypatch.setattr(lm, "SCORE_WINDOW", window)
    rng = np.random.default_rng(1)
    model, count = random_model(rng), np.array([7, 1, 40, 3, 12, 1])
    code = rng.integers(0, lm.CLASSES * lm.CLASS_WORDS + lm.SHAPES, count.sum())
    got = np.split(model.score(code, count), np.cumsum(count)[:-1])
    for g, c in zip(got, np.split(code, np.cumsum(count)[:-1])):
        assert np.allclose(g, by_hand(model, c), atol=1e-4)


def test_gradients(monkeypatch):
    for name, value in (("CLASSES", 3), ("CLASS_WORDS", 4), ("SHAPES", 2), ("UNITS", 5)):
        monkeypatch.setattr(lm, name, value)
    rng = np.random.default_rng(0)
    model, count = random_model(rng), np.array([4, 1, 6, 3])
    code = rng.integers(0, 14, count.sum())
    inputs, starts = lm._inputs(code, count)

    def total(grads=None):
        window = next(lm.Lanes(count, 2).windows(100))
        kept = []
        h = model.forward([inputs[p] for p in window], [starts[p] for p in window], np.zeros((2, 5)), kept)
        p = np.concatenate(window)
        if grads is None:
            return model.log_probability(np.concatenate(h), code[p]).sum()
        _, dh = model.log_probability(np.concatenate(h), code[p], grads)
        model._back(kept, np.split(dh, np.cumsum([len(x) for x in h])[:-1]), grads)

    grads = [np.zeros_like(w) for w in model.weights]
    total(grads)
    for w, g in zip(model.weights, grads):
        for i in list(np.ndindex(w.shape))[::7]:
            w[i] += 1e-5
            up = total()
            w[i] -= 2e-5
            assert (up - total()) / 2e-5 == pytest.approx(g[i], abs=1e-6)
            w[i] += 1e-5


def test_lanes_cover_every_token_once():
    rng = np.random.default_rng(2)
    count = rng.integers(1, 50, 30)
    for lanes in (lm.Lanes(count, 4), lm.Lanes.even(int(count.sum()), 7)):
        seen = np.concatenate([p for w in lanes.windows(6) for p in w])
        assert np.array_equal(np.sort(seen), np.arange(count.sum()))


def test_query_and_held_out_gain(spark):
    from sentrymill.llm.queries import queries

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries()["op10_gru_lm"](spark, SF).collect()
    assert base_of(rows) == brute(docs)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.1 * sum(r.n_tokens for r in out)


def test_shape_classes_share_out_their_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = lm.word_counts(docs)
    v = lm.vocabulary_of(counts)
    own = {int(h) for h in v.hashes[v.slots >= 0].view(np.int64)}
    by = Counter()
    for r in counts.collect():
        if r.h not in own:
            by[r["shape"]] += r.c + 1
    for k in range(lm.SHAPES):  # the words' shares and that of an unknown word
        assert by[k] + 1 == v.shape_n[k] + v.shape_v[k] + 1
    place = v.find(np.append(v.hashes, np.uint64(5)))
    assert np.array_equal(place, [*range(len(v.hashes)), -1])
    assert lm.Tokens(pa.array(["a b", None])).count.tolist() == [3, 1]


def test_scores_do_not_depend_on_how_the_table_is_split(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 5000)  # some shards in each round
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = []
    for parts in (1, 5, 16):
        rows = lm.scored(docs.repartition(parts)).collect()
        found.append({r.doc_id: r.score for r in rows})
    for other in found[1:]:
        assert other.keys() == found[0].keys()
        assert all(other[i] == pytest.approx(x, rel=1e-6, abs=1e-6) for i, x in found[0].items())


def test_shard_chunks_do_not_depend_on_batches(monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_WORDS", 20)
    rng = np.random.default_rng(4)
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(0, 15, 60)]
    table = pa.table({"shard": pa.array(np.sort(rng.integers(0, 4, 60)).astype(np.int32)), "text": texts})
    chunks = lambda size: [(int(k), t.count.tolist()) for k, t in lm._shard_chunks(iter(table.to_batches(max_chunksize=size)))]
    want = chunks(60)
    assert len(want) > 8 and all(chunks(size) == want for size in (1, 7, 13))
    assert sum((c for _, c in want), []) == [len(t.split()) + 1 for t in texts]

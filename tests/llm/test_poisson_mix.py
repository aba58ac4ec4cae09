import hashlib
import math

import pytest

from sentrymill.llm import poisson_mix as pm

SCHEMA = "doc_id long, source string, text string, rate int, copy string, cdf int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "c", 2) for r in rows], SCHEMA.replace("text", "text_").replace("rate", "rate"))


def u(*parts):
    return int(hashlib.md5(":".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16) / 2**52


def inverse(mean, x):
    p = c = math.exp(-mean)
    k = 0
    while c <= x and k < mean + 10 * math.sqrt(mean) + 31:
        k += 1
        p *= mean / k
        c += p
    return k


def brute(rows, weights=None, aim=None, seed=pm.SEED):
    n = {}
    for _, s in rows:
        n[s] = n.get(s, 0) + 1
    w = {s: math.sqrt(k) for s, k in n.items()} if weights is None else {s: weights.get(s, 0) for s in n}
    total = sum(w.values()) or 1
    out = []
    for d, s in rows:
        rate = (len(rows) if aim is None else aim) / total * w[s] / n[s]
        draws = max(1, math.ceil(rate / 500))
        count = sum(inverse(rate / draws, u(seed, d, k)) for k in range(draws))
        out += [(d, s, k, count) for k in range(count)]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc.doc_id, r.doc.source, r.copy, r.n_copies) for r in df.collect()), key=repr)


ROWS = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(400)] + [(None, "hot"), (5, None), (6, None), (6, None), (None, None)]


@pytest.mark.parametrize("weights,aim", [(None, None), ({"hot": 1.0, None: 3.0, "s1": 1.0}, 300), (None, 0), ({}, None)])
def test_counts(spark, weights, aim):
    df = pm.replicated(frame(spark, ROWS), weights=weights, rows=aim)
    assert got(df) == brute(ROWS, weights, aim)


def test_salted_join_and_high_rates(spark, monkeypatch):
    rows = [(1, "one")] + [(i, "many") for i in range(2, 50)]
    want = brute(rows, {"one": 1, "many": 1}, 2400)
    assert 1000 < len([r for r in want if r[0] == 1]) < 1400
    assert got(pm.replicated(frame(spark, rows), weights={"one": 1, "many": 1}, rows=2400)) == want
    monkeypatch.setattr(pm, "BROADCAST_BYTES", 0)
    assert got(pm.replicated(frame(spark, ROWS))) == brute(ROWS)


def test_shuffled_over_all_partitions_and_columns_kept(spark):
    docs = frame(spark, ROWS)
    keys = [r.shuffle_key for r in pm.replicated(docs).collect()]
    assert keys == sorted(keys)
    mixed = pm.mixed(docs)
    assert mixed.columns == docs.columns
    ids = [r.doc_id for r in mixed.collect() if r.doc_id is not None]
    assert ids != sorted(ids) and len(mixed.collect()) == len(keys)


def test_empty_table(spark):
    assert pm.replicated(frame(spark, ROWS).limit(0)).collect() == []


def test_means_follow_rates(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "if(id % 4 = 0, 'a', 'b') AS source")
    by = {r.source: r.c for r in pm.mixed(docs, weights={"a": 3, "b": 1}, rows=40000).groupBy("source").agg({"*": "count"}).withColumnRenamed("count(1)", "c").collect()}
    assert abs(by["a"] - 30000) < 900 and abs(by["b"] - 10000) < 500

"""Exact duplicates and the index of digests seen before."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrymill.llm import digest_index as di

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, digest string, row int, id int, n int"


def digest(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return hashlib.sha256(lowered.encode()).hexdigest()


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(digest(text), []).append(doc_id)
    least = lambda i: (i is not None, i or 0)
    return sorted(((i, max(groups[digest(t)], key=least), len(groups[digest(t)]), digest(t)) for i, t in rows), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


def check(df, rows):
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    found = df.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == brute(rows)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({digest(t) for _, t in rows}) and all(r.doc_id == r.keep_id for r in kept)
    assert len({r.text_sha256 for r in kept}) == len(kept)


ROWS = [
    (1, "Some text"), (2, "some TEXT"), (3, "Some text "), (4, None), (5, ""), (6, "Été"), (7, "été"),
    (7, "été"), (None, "some text"), (None, "alone"), (None, "alone"), (8, "İ"), (9, "i̇"), (10, "\x00"),
    (11, "long " * 50000), (12, "LONG " * 50000), (0, "some text"), (13, "last"),
]


@pytest.mark.parametrize("history", ["id <= 5", "true", "false", "id % 2 = 0", "id IS NULL", "id = 0"])
def test_any_history_gives_the_same(spark, history):
    check(di.exact_duplicates(frame(spark, ROWS), F.expr(history)), ROWS)


def test_empty_table(spark):
    docs = frame(spark, ROWS).limit(0)
    assert di.exact_duplicates(docs, di.older_half(docs)).collect() == []


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "X"), ("c", "y"), ("d", "x")], "doc_id string, text string")
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in di.exact_duplicates(docs, F.col("id") < "c").collect()}
    assert found == {"a": ("d", 3, False), "b": ("d", 3, False), "c": ("c", 1, True), "d": ("d", 3, True)}


def test_query_equals_brute_force(spark):
    from sentrymill.llm.queries import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(queries()["op12_digest_index"](spark, SF), rows)


def test_several_shards(spark, monkeypatch):
    monkeypatch.setattr(di, "SHARD_KEYS", 40)
    rows = [(k, f"text {k % 300}") for k in range(500)]
    check(di.exact_duplicates(frame(spark, rows), F.expr("id % 3 = 0")), rows)


def words(n, seed):
    return np.random.default_rng(seed).integers(0, 2**63, (n, 4), dtype=np.uint64)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_and_minimal(n):
    held = words(n, 1)
    hashed = di.PerfectHash.from_bytes(di.PerfectHash.over(held).to_bytes())
    assert sorted(hashed.slots(held).tolist()) == list(range(n))
    other = hashed.slots(words(5000, 2))
    assert ((other >= -1) & (other < max(n, 1))).all()
    assert n < 5000 or len(hashed.to_bytes()) * 8 < 5 * n


def test_digests_that_share_most_bytes_are_told_apart():
    held = words(1, 3).repeat(400, axis=0)
    held[np.arange(400), np.arange(400) % 4] += np.arange(400, dtype=np.uint64) * np.uint64(1 << 40)
    held = np.unique(held, axis=0)
    assert sorted(di.PerfectHash.over(held).slots(held).tolist()) == list(range(len(held)))


def test_next_delivery_adds_only_new_texts(spark):
    old = frame(spark, [(1, "one"), (2, "two"), (3, "ONE")])
    index = di.build_index(di.distinct_digests(di.digested(old).withColumn("row", F.col("id")), 1))
    came = frame(spark, [(10, "Two"), (11, "three"), (12, "Three"), (13, None)])
    assert sorted(r.doc_id for r in di.new_texts(came, index, 1).collect()) == [12, 13]

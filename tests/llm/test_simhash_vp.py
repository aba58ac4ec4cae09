import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sentrymill.llm import simhash_vp as sv
from sentrymill.llm.components import connected_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, fingerprint string, place string, f int, component_id int"


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, distance=2):
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group):
        least[g] = min([x for x in (d, least.get(g)) if x is not None], default=None)
    return sorted(((d, f"{f:016x}", least[g]) for (d, _), f, g in zip(rows, fps, group)), key=repr)


ROWS = [
    (5, "the quick Brown fox"), (2, "THE quick\tbrown  fox"), (9, None), (3, ""), (8, " \n "), (7, "one two"), (6, "ONE TWO"),
    (None, "one two"), (4, "ünïcode É words"), (1, "z" * 50000), (10, "w " * 20000), (11, "a\x00b c d\x1ce f"), (11, "a\x00b c d\x1ce f"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)


def test_edge_cases(spark):
    got = sv.near_duplicate_components(frame(spark, ROWS)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(ROWS)


def test_empty_table(spark):
    assert sv.near_duplicate_components(frame(spark, ROWS).limit(0)).collect() == []
    assert sv.drop_near_duplicates(frame(spark, ROWS).limit(0)).collect() == []


def test_query_equals_brute_force(spark):
    from sentrymill.llm.queries import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries()["op4_simhash_vp"](spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_drop_keeps_one_of_each_group(spark):
    docs = frame(spark, ROWS)
    kept = sv.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {c for _, _, c in brute(ROWS)}


def clustered(n, rng):
    """Random fingerprints and chains of ones a bit or two apart."""
    base = rng.integers(0, 2**63, n // 3, dtype=np.uint64) * np.uint64(2)
    out = [base]
    for _ in range(2):
        flip = rng.integers(0, 64, (2, len(base))).astype(np.uint64)
        base = base ^ (np.uint64(1) << flip[0]) ^ (np.uint64(1) << flip[1])
        out.append(base)
    return np.unique(np.concatenate(out))


def pairs(f, distance=2):
    x, y = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= distance)
    return {(int(a), int(b)) for a, b in zip(x, y) if a < b}


def test_every_pair_meets_in_a_shard():
    f = clustered(3000, np.random.default_rng(3))
    tree = sv.ShardTree(f[:200], 5, 2)
    row, shard = tree.route(f)
    at = [set() for _ in f]
    for r, s in zip(row.tolist(), shard.tolist()):
        at[r].add(s)
    found = pairs(f)
    assert len(found) > 1000 and all(at[a] & at[b] for a, b in found)
    assert len(row) < 4 * len(f)


@pytest.mark.parametrize("dense", [False, True])
def test_links_in_shard(dense):
    rng = np.random.default_rng(4)
    f = clustered(4000, rng)
    if dense:  # all within a few bits of one another
        f = np.unique(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (2, 1500)).astype(np.uint64), axis=0))
    got = sv.links_in_shard(f, 2)
    want = sv.Forest(len(f))
    p = np.array(sorted(pairs(f)))
    want.link(p[:, 0], p[:, 1])
    assert (got == want.label).all()


def test_sharded_links_equal_unsharded(spark):
    f = clustered(3000, np.random.default_rng(5))
    df = spark.createDataFrame(pa.table({"f": f.view(np.int64)}))
    got = {r.node: r.root for r in sv.linked_fingerprints(df, 2, shard_rows=100).collect()}
    signed = np.sort(f.view(np.int64))
    label = sv.links_in_shard(signed.view(np.uint64), 2)
    count = np.bincount(label, minlength=len(f))
    want = {int(x): int(signed[k]) for x, k in zip(signed, label) if count[k] > 1}
    assert got == want


def test_components_of_long_chain_star_and_nulls(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1500)] + [(5000, 5000), (None, 3), (4, None)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1500)}

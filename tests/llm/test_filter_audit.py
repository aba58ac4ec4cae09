"""Filter audit against filters applied one after the other."""

import re
from collections import defaultdict
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from sentrymill.llm import filter_audit as fa

SCHEMA = "doc_id long, text string, source string, part string, failed int, good int"


def failures(rows):
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        found = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and doc_id > first[text]}
        out.append({f for f, fails in found.items() if fails})
    return out


def brute(rows, labels):
    """Each order of the filters applied to each part, document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed = failures(rows)
    out = {}
    shapley = defaultdict(int)
    for part in {s or "" for _, _, s in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                fails = sum(name in f for _, f in mine)
                shapley[part, name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), fails - len(gone), sum(f == {name} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df):
    assert df.columns == ["part", "filter_order", "step", *fa.COUNTS]
    rows = [tuple(r) for r in df.collect()]
    assert len({r[:3] for r in rows}) == len(rows)
    return {r[:3]: r[3:] for r in rows}


LONG = " ".join(f"word{k}" for k in range(250))
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (1, LONG, "b"), (None, LONG, "b"), (3, None, None), (4, "", "a"),
    (5, "", ""), (6, "ab " * 300, "a"), (7, "AB " * 300, "b"), (8, LONG + " 100%", "a"), (9, LONG.upper(), None),
    (10, "x y z ÉÉ", "b"), (11, LONG + "\x0b\x0c\x1cB", "a"), (12, "w " * 199, "b"),
    (13, " ".join(["a", "b"] * 50 + [f"c{k}" for k in range(98)]) + " d e", "a"), (14, "#", "c"), (None, None, "c"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (4, 1, 1), (7, None, 1), (8, 1, None), (None, 1, 1), (99, 1, 1)]


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "p", 7, 8) for r in rows], SCHEMA)
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    return fa.filter_interactions(docs, marks)


def test_edge_cases(spark):
    assert got(run(spark, ROWS, LABELS)) == brute(ROWS, LABELS)


def test_no_labels_and_empty_table(spark):
    assert got(run(spark, ROWS, [])) == brute(ROWS, [])
    assert got(run(spark, [], LABELS)) == {}


def test_many_parts(spark):
    rows = [(k, LONG if k % 3 else "#", f"part-{k % 101}") for k in range(500)]
    assert got(run(spark, rows, LABELS)) == brute(rows, LABELS)


def test_contraction_equals_counting():
    rng = np.random.default_rng(1)
    tensor = rng.integers(0, 9, (2, 2, 2, 2))
    _, taken = fa.step_selectors(3)
    got_ = fa.contract(tensor, taken["removed"])
    for row, choice in enumerate(taken["removed"]):
        want = [sum(t[a, b, c] for a in (0, 1) for b in (0, 1) for c in (0, 1)
                    if choice[0, a] and choice[1, b] and choice[2, c]) for t in tensor]
        assert got_[:, row].tolist() == want


def test_other_filters(spark):
    counts = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 1, 1), ("p", 3, 2, 0, 2)], "part string, failed int, n long, good long, toxic long")
    rows = {(r.filter_order, r.step): r for r in fa.audited(counts, "xy").collect()}
    assert {k: (r.kept, r.removed, r.redundant, r.unique_fails, r.toxic_lost, r.shapley) for k, r in rows.items()} == {
        ("xy", 1): (5, 5, 0, 3, 3, 8), ("xy", 2): (5, 0, 2, 0, 0, 2),
        ("yx", 1): (8, 2, 0, 0, 2, 2), ("yx", 2): (5, 3, 2, 3, 1, 8)}


def test_first_of_equal_texts_is_found_without_gathering_copies(spark):
    docs = spark.createDataFrame([(k, "same text", "a") for k in range(1000)], "doc_id long, text string, source string")
    failed = fa.document_failures(docs, "doc_id", "text", "source")
    later = failed.where(F.col("failed").bitwiseAND(16) > 0)
    assert later.count() == 999 and later.where("doc_id = 0").isEmpty()

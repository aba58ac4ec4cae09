import itertools
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from sentrymill.llm import spaced_seeds as ss

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, item_id string, matched_words int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items):
    """Every shift of every item, every stretch of every alignment."""
    out = []
    for d, t in docs:
        text = words(t)
        for i, own in {(i, tuple(words(x))) for i, x in items}:
            if len(own) < 8:
                continue
            most = 0
            for shift in range(1 - len(own), len(text)):
                eq = [0 <= k + shift < len(text) and own[k] == text[k + shift] for k in range(len(own))]
                if sum(eq) > most:
                    for a in range(len(own)):
                        for b in range(a + 1, len(own) + 1):
                            if 5 * sum(eq[a:b]) >= 4 * (b - a):
                                most = max(most, sum(eq[a:b]))
            if most >= min(12, -(-4 * len(own) // 5)):
                out.append((d, i, most))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.item_id, r.matched_words) for r in df.collect()), key=repr)


def test_masks_hit_every_15_words_with_3_replaced():
    for bad in itertools.combinations(range(15), 3):
        assert any(not any(i + o in bad for o in m) for m in ss.MASKS for i in range(15 - m[-1])), bad


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), max_size=25))
def test_best_segment(flags):
    got, i, j = ss.best_segment(np.array(flags, bool))
    want = max([sum(flags[a:b]) for a in range(len(flags)) for b in range(a, len(flags) + 1) if 5 * sum(flags[a:b]) >= 4 * (b - a)], default=0)
    assert got == want == sum(flags[i:j]) and 5 * got >= 4 * (j - i)


def cases():
    item = " ".join(WORDS)
    def changed(*at):
        return " ".join("other" if k in at else w for k, w in enumerate(WORDS))
    items = [(1, item), (2, "  ".join(WORDS[:8]).upper()), (3, "alpha beta"), (4, None), (5, ""), (1, item), (None, " ".join(WORDS[5:]) + " end")]
    docs = [
        (10, f"before {item} after"), (11, changed(3, 9, 14)), (12, changed(0, 2, 4, 6, 8, 10)), (13, None), (14, ""),
        (15, "filler " * 40000 + changed(7)), (16, item.upper().replace(" ", "!! ")), (17, "alpha beta"), (None, item),
        (18, " ".join(WORDS[4:16])), (19, " ".join(WORDS[:7])), (20, item), (20, item), (21, f"{item} {item}"),
    ]
    return docs, items


@pytest.mark.parametrize("chunk_words", [1, 250_000])
def test_edge_cases(spark, chunk_words):
    docs, items = cases()
    d = spark.createDataFrame([(*x, "a", 0) for x in docs], DOCS)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    short = [(i, t if i != 15 else t.replace("filler ", "")) for i, t in docs]
    want = brute(short, items)
    assert found(ss.benchmark_overlaps(d, b, chunk_words=chunk_words)) == want
    kept = ss.drop_contaminated(d, b, chunk_words=chunk_words)
    assert kept.columns == d.columns
    hit = {x[0] for x in want}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in hit)
    assert ss.benchmark_overlaps(d.limit(0), b).collect() == []
    assert ss.benchmark_overlaps(d, b.limit(0)).collect() == []
    assert ss.drop_contaminated(d, b.limit(0)).count() == len(docs)


def test_query_finds_what_all_alignments_find(spark):
    from sentrymill.llm.queries import queries

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries()["op3_spaced_seeds"](spark, SF).collect()
    near = {(d, i) for d, t in docs for i, x in items if len(set(words(t)) & set(words(x))) >= 10}
    want = [r for d, i in near for r in brute([(d, dict(docs)[d])], [(i, dict(items)[i])])] if len(near) < 60 else None
    if want is None:  # whole passages by plain text search
        want = [(d, i) for d, t in docs for i, x in items if f" {' '.join(words(x))} " in f" {' '.join(words(t))} "]
        assert set(want) <= {(r.doc_id, r.item_id) for r in got} and len(want) > 0
    else:
        assert sorted((r.doc_id, r.item_id, r.matched_words) for r in got) == sorted(want)


@pytest.mark.parametrize("size", range(ss.ITEM_WORDS, 16))
def test_no_layout_of_an_item_is_lost(size):
    least = min(ss.MATCHED_WORDS, -(-4 * size // 5))
    index = ss.SeedIndex([1], [" ".join(WORDS[:size])])
    layouts = list(itertools.combinations(range(size), size - least))
    texts = [" ".join("other" if k in bad else w for k, w in enumerate(WORDS[:size])) for bad in layouts]
    hit = index.search(ss.pa.array(texts))
    assert hit["doc"].tolist() == list(range(len(texts))) and (hit["matched_words"] == least).all()


def test_index_without_seeds_finds_nothing():
    assert len(ss.SeedIndex([1], ["alpha beta"]).search(ss.pa.array(["alpha beta", None]))["doc"]) == 0


def test_many_items_with_one_opening_cost_little():
    opening = " ".join(f"w{k}" for k in range(9))
    items = [f"{opening} " + " ".join(f"i{n}x{k}" for k in range(10)) for n in range(12_000)]
    index = ss.SeedIndex(list(range(len(items))), items)
    start = time.perf_counter()
    hit = index.search(pa.array([f"{opening} {opening}", items[7]], pa.large_string()))
    assert time.perf_counter() - start < 1
    assert hit["item"].tolist() == [7] and hit["matched_words"].tolist() == [19]

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from sentrymill.llm import quality_rules as qr

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, kept string, bucket int, id int, n_words string"
WORD = r"[^\x20\x09-\x0D]+"


def brute_base(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def buckets(text):
    w = qr._words(pa.array([text], pa.string()))
    return qr.ngrams(w)[0].tolist()


def brute(rows, good):
    target, corpus = Counter(), Counter()
    for i, t in rows:
        corpus.update(buckets(t))
        if i in good:
            target.update(buckets(t))
    n_t, n_c = sum(target.values()) + qr.BUCKETS, sum(corpus.values()) + qr.BUCKETS
    out = []
    for i, t in rows:
        b = buckets(t)
        score = sum(math.log((target[x] + 1) / n_t) - math.log((corpus[x] + 1) / n_c) for x in b) / max(1, len(b)) if target else 0.0
        base = brute_base(t)
        out.append((i, *base, round(score, 9), not base[-1] and score >= qr.THRESHOLD))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, round(r.score, 9), r.kept)
                   for r in df.collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab #|é\n\r\t\x0b ", max_size=60), max_size=4))
def test_base_figures(texts):
    w = qr._words(pa.array(texts, pa.string()))
    got = qr.base_figures(w, w.data)
    assert list(zip(*[got[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])) == [brute_base(t)[:5] for t in texts]


ODD = [(1, None), (2, ""), (3, " \n "), (4, "a b c d e f g h " * 3), (5, "x" * 60000), (6, "w x y z " * 20000), (None, "one two"),
       (7, "## $$ <b> |"), (8, "good words here " + " ".join(f"w{i}" for i in range(30))), (8, "good words here"), (9, "same\nsame\n same\n\n")]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(*r, "k", 1, 2, "n") for r in ODD], DOCS)
    labels = spark.createDataFrame([(8, 1), (8, 1), (7, 0), (None, 1), (99, 1), (2, None)], "doc_id long, quality int")
    assert rows_of(qr.judged(docs, qr.fit(docs, labels))) == brute(ODD, {8})
    none = qr.fit(docs, labels.limit(0))
    assert not none.any() and rows_of(qr.judged(docs, none)) == brute(ODD, set())
    assert qr.judged(docs.limit(0), qr.fit(docs.limit(0), labels)).collect() == []


def test_query_equals_brute_force_and_keeps_good_documents(spark):
    from sentrymill.llm.queries import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries()["op6_quality_rules"](spark, SF)
    assert rows_of(got) == brute(rows, {i for i, q in label.items() if q == 1})
    judged = {r.doc_id: r for r in got.collect()}
    assert all(judged[i].kept for i, q in label.items() if q == 1 and not judged[i].base_failed)
    assert np.mean([judged[i].kept for i, q in label.items() if q == 0]) < 0.3

"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentrymill.llm import spelling as sp

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, word string, n int, shard int"


def brute_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    """By trying: delete one letter of the longer, or one at the same place of both."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return any(a[:k] + a[k + 1:] == b[:k] + b[k + 1:] for k in range(len(a)))
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows):
    counts = brute_counts(rows)
    gaps, near = {}, {w: set() for w in counts}
    for w in counts:  # words one edit apart share a word with one letter less, or are it
        for v in {w[:k] + w[k + 1:] for k in range(len(w))} | {w}:
            gaps.setdefault(v, set()).add(w)
    for group in gaps.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    forms = {}
    for w, found in near.items():
        if found:
            top = min(found, key=lambda v: (-counts[v], v))
            if counts[top] >= 10 * counts[w]:
                forms[w] = top
    out = []
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, len(near[w]), counts.get(forms.get(w))))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def edited(word, rng, letters="abcdefghijklmnopqrstuvwxyzàéÀÿ"):
    k, c = rng.randrange(len(word)), rng.choice(letters)
    return rng.choice([word[:k] + word[k + 1:], word[:k] + c + word[k:], word[:k] + c + word[k + 1:]])


def vocabulary(n, seed, letters="abcdefghijklmnopqrstuvwxyz"):
    """Random words and one or two edits of some of them."""
    rng = random.Random(seed)
    words = ["".join(rng.choices(letters, k=rng.randrange(7, 13))) for _ in range(n)]
    for w in words[:n // 2]:
        words.append(edited(w, rng))
        words.append(edited(words[-1], rng))
    return sorted({w for w in words if len(w) >= 7})


TEXTS = [
    (0, "separate " * 30 + "seperate seperate, separat separat Separates separates"),
    (1, None), (2, ""), (3, "a bc defghij"),
    (4, "Ångström ångström Ångström × naïveté naïvete naïveté×÷ ÀÉÎÕÜ÷x ÀÉÎÕÜ÷x"),
    (None, "separate seperate nothing nothing nothink nothink"), (0, "separate repeated repeated rows rows"),
    (0, "separate repeated repeated rows rows"), (5, "z" * 300 + " " + "z" * 300 + " " + "z" * 301 + " " + "z" * 301),
    (6, "abcdefgh-abcdefgh_abcdefgi abcdefgi1abcdefgiĀabcdefgi​abcdefgh"),
    (7, "stopped stopped stpoped stpoped dropped dropped"),
]


def test_edge_cases(spark):
    assert got(sp.spelling_variants(frame(spark, TEXTS))) == brute(TEXTS)


def test_empty_table(spark):
    assert got(sp.spelling_variants(frame(spark, TEXTS).limit(0))) == []
    assert got(sp.spelling_variants(frame(spark, [(1, None), (2, "")]))) == []


def test_chains_of_forms_lead_to_the_last(spark):
    chain = ["alphabe", "alphabet", "alphabeta", "alphabetas"]
    rows = [(k, " ".join([w] * 2 * 10 ** k)) for k, w in enumerate(chain)]
    want = brute(rows)
    assert got(sp.spelling_variants(frame(spark, rows))) == want
    assert {r[2] for r in want if r[0] in chain} == {"alphabetas"}


def test_query_equals_brute_force(spark):
    from sentrymill.llm.queries import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = got(queries()["op13_spelling_variants"](spark, SF))
    assert found == brute(rows) and any(r[1] for r in found)


def all_pairs(words):
    gaps, out = {}, set()
    for w in words:
        for v in {w[:k] + w[k + 1:] for k in range(len(w))} | {w}:
            gaps.setdefault(v, []).append(w)
    for group in gaps.values():
        out |= {(a, b) for a in group for b in group if a < b and one_edit(a, b)}
    return out


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "abc", "aà"])
def test_near_pairs_in_one_shard(letters):
    words = vocabulary(800, 5, letters)
    found = sp.near_pairs(pa.array(words), *(np.full(len(words), x) for x in (True, False, False)))
    pairs = [tuple(sorted((words[a], words[b]))) for a, b in found.T]
    assert len(pairs) == len(set(pairs)) and set(pairs) == all_pairs(words)


def test_shards_find_each_pair_once(spark):
    words = vocabulary(3000, 6)
    df = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, n long")
    rows = [(r.word, r.near) for r in sp.near_words(df, shard_words=150).collect()]
    pairs = all_pairs(words)
    assert len(rows) == len(set(rows)) and set(rows) == pairs | {(b, a) for a, b in pairs}
    assert len(pairs) > 2000


def test_words_of_a_long_text_are_counted_by_pieces(monkeypatch):
    text = " ".join(vocabulary(200, 7)) + "q" * 50
    whole = sp.text_words("3", text)
    monkeypatch.setattr(sp, "PIECE_CHARS", 11)
    assert sp.text_words("3", text) == whole


def test_endless_words():
    long = "ab" * 20000
    words = [long, long + "a", long[:-1] + "c", long + "aa", long + "abc"]
    found = sp.near_pairs(pa.array(words), *(np.full(5, x) for x in (True, False, False)))
    assert {tuple(sorted(p)) for p in found.T.tolist()} == {(0, 1), (0, 2), (1, 3)}

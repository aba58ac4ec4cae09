import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sentrymill.llm import token_files as tf
from sentrymill.session import shared_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start string, id string, part int"
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = tf.WordEncoder(PATH, 1)


def whole(texts):
    return [e.ids + [1] for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text("abZ%$' \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ́<|>.1é", max_size=40), max_size=6))
def test_words_encode_as_whole_texts(texts):
    ids, lengths = ENCODER([t.encode() for t in texts])
    parts = np.split(ids, np.cumsum(lengths)[:-1]) if texts else []
    assert [p.tolist() for p in parts] == whole(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.sampled_from([(8, 8, 16), (16, 16), (8, 8, 8, 8), (32,)]))
def test_round_trip_and_random_access(values, widths):
    ids = np.array(values, np.uint32)
    cut = len(ids) // 3
    f = tf.TokenFile(tf.encode(ids, np.array([5, -7]), np.array([False, True]), np.array([0, cut, len(ids)]), widths))
    assert f.slice(0, len(ids)).tolist() == values
    assert f.document(0).tolist() == values[:cut] and f.document(1).tolist() == values[cut:]
    order = np.random.default_rng(1).permutation(len(ids))
    assert f.take(order).tolist() == ids[order].tolist()
    if values:
        with pytest.raises(IndexError):
            f.take([len(values)])


def test_ids_too_wide():
    with pytest.raises(ValueError):
        tf.encode(np.array([70000], np.uint32), np.zeros(1), np.zeros(1), np.array([0, 1]), (16,))


def brute(rows):
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(whole([text or ""])[0], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("shard_tokens", [1, 40, 1 << 20])
def test_digest(spark, shard_tokens):
    rows = [(7, "Hello world's END"), (3, None), (None, "no id"), (9, ""), (4, "long " * 30000), (1, "ünï <|endoftext|> x"), (12, "same"), (13, "same")]
    docs = spark.createDataFrame([(*r, "s", "i", 1) for r in rows], SCHEMA)
    got = tf.token_file_digest(docs, PATH, shard_tokens=shard_tokens)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "", "", 0)] * 3 + [(2, "c", "", "", 0)], SCHEMA)
    got = sorted(map(tuple, tf.token_file_digest(docs, PATH).collect()), key=lambda r: r[1])
    assert got == brute([(1, "a b")] * 3 + [(2, "c")])
    assert tf.token_file_digest(docs.limit(0), PATH).collect() == []


def test_files_open_at_any_token(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = shared_folder(spark, "token-test")
    files = tf.write_token_files(docs, folder, PATH, shard_tokens=20_000).orderBy("start").collect()
    assert len(files) > 3
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    ids = [i for _, t in sorted(rows) for i in whole([t])[0]]
    for f in files:
        opened = tf.open_token_file(f.file)
        for k in (0, opened.n_tokens // 2, opened.n_tokens - 1):
            assert opened.take(k)[0] == ids[f.start + k]


def test_query(spark):
    from sentrymill.llm.queries import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries()["op1_token_files"](spark, sf).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_accented_words_go_to_the_merges_directly():
    encoder = tf.WordEncoder(PATH, 1)
    words = ["".join(chr(c) for c in range(0xC0 + k, 0x100, 5)) + "ab" for k in range(5)] + ["ÉCOLE", "straße", "çà", "ÿ", "Ñandú,", "a×b", "÷", "ÅÅ", "µé", "é", "Å"]
    texts = [" ".join(words), *words]
    fallen_back = []
    full = encoder.tokenizer

    class Watched:
        def encode_batch_fast(self, parts, **options):
            fallen_back.extend(parts)
            return full.encode_batch_fast(parts, **options)

    encoder.tokenizer = Watched()
    ids, lengths = encoder([t.encode() for t in texts])
    assert [p.tolist() for p in np.split(ids, np.cumsum(lengths)[:-1])] == whole(texts)
    assert not set(fallen_back) & {"École", "straße", "çà", "ÿ", "Ñandú"} and {"÷", "µé"} <= set(fallen_back)


def test_words_are_forgotten_between_stretches(monkeypatch):
    monkeypatch.setattr(tf, "REMEMBERED_WORDS", 3)
    encoder = tf.WordEncoder(PATH, 1)
    for texts in (["a b c d", "é f"], ["a f"], ["", "x. y a"], [], ["b b"]):
        ids, lengths = encoder([t.encode() for t in texts])
        parts = np.split(ids, np.cumsum(lengths)[:-1]) if texts else []
        assert [p.tolist() for p in parts] == whole(texts)
        assert len(encoder.known) <= 3 + 6

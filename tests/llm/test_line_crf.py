import itertools
import re
import zlib

import numpy as np
import pyarrow as pa

from sentrymill.llm import line_crf as lc

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, score string, y int, key string, id int, quality int"
ODD = [(1, None), (2, ""), (3, " \n\t\n"), (4, "one"), (None, "no id here"), (5, "word " * 30000), (6, "a\n" * 3000), (7, "same text"), (7, "same text"), (8, "ünï\x00 \x0b\x0c é\r\nß")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", 0, "k", 1, 0) for r in rows], DOCS)


def test_forward_backward_equals_all_labelings():
    rng = np.random.default_rng(1)
    count = np.array([3, 1, 5, 2])
    unary, pair = rng.normal(size=11), rng.normal(size=(2, 2))
    alpha, beta, total = lc.Chains(count).run(unary, pair)
    at = 0
    for d, n in enumerate(count):
        u = unary[at:at + n]
        weight = {y: sum(u[k] * y[k] for k in range(n)) + sum(pair[a, b] for a, b in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=int(n))}
        z = np.log(sum(np.exp(list(weight.values()))))
        assert np.isclose(total[d], z)
        for k in range(n):
            p = sum(np.exp(w - z) for y, w in weight.items() if y[k])
            assert np.isclose(np.exp(alpha[at + k, 1] + beta[at + k, 1] - total[d]), p)
        at += n


def test_lines_are_those_with_words_and_texts_are_independent():
    texts = [t for _, t in ODD] + ["a b\n\n c\n", "A!! B!!\nA!! B!!\nx"]
    lines = lc.Lines(pa.array(texts))
    want = [max(1, sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (t or "").split("\n"))) for t in texts]
    assert lines.count.tolist() == want
    alone = np.concatenate([lc.Lines(pa.array([t], pa.string())).x for t in texts])
    assert np.allclose(lines.x, alone)


def labelled(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_held_out_accuracy_and_query(spark):
    from sentrymill.llm.queries import queries

    docs, labels = labelled(spark, SF)
    got = {r.doc_id: r for r in queries()["op9_line_crf"](spark, SF).collect()}
    assert len(got) == docs.count()
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    truth = [(got[x.doc_id].predicted, x.quality) for x in labels.collect() if got[x.doc_id].held_out]
    assert np.mean([a == b for a, b in truth]) >= 0.97 and len(truth) > 50


def test_labels_of_held_out_rows_are_never_used(spark):
    docs, labels = labelled(spark, SF)
    flipped = labels.selectExpr("doc_id", "if(crc32(CAST(doc_id AS STRING)) % 5 = 0, 1 - quality, quality) AS quality")
    assert np.array_equal(lc.fit(docs, labels).weight, lc.fit(docs, flipped).weight)


def test_edge_cases(spark):
    docs = frame(spark, ODD)
    model = lc.fit(*labelled(spark, SF))
    rows = lc.scored(docs, model).collect()
    assert sorted([r.doc_id for r in rows], key=repr) == sorted([i for i, _ in ODD], key=repr)
    by = {r.doc_id: r for r in rows}
    assert by[1].score == by[2].score == by[3].score and by[5].predicted == 0
    kept = lc.accepted(docs, model)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r.doc_id) for r in rows if r.predicted)
    assert lc.scored(docs.limit(0), model).collect() == [] and lc.accepted(docs.limit(0), model).collect() == []


def test_unusable_labels_give_one_half(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    assert {r.score for r in lc.scored(docs, lc.fit(docs, none)).collect()} == {0.5}
    assert {r.score for r in lc.scored(docs, lc.fit(docs, none.limit(0))).collect()} == {0.5}


def test_copies_of_an_id_neither_reach_the_driver_nor_weigh(spark, monkeypatch):
    docs, labels = labelled(spark, SF)
    one = labels.where("crc32(CAST(doc_id AS STRING)) % 5 != 0").orderBy("doc_id").first().doc_id
    copies = docs.where(f"doc_id = {one}").crossJoin(spark.range(300)).select(docs.columns)
    seen = []
    fit = lc.LineCrf.fit
    monkeypatch.setattr(lc.LineCrf, "fit", lambda texts, y: seen.append(len(texts)) or fit(texts, y))
    alone, repeated = lc.fit(docs, labels), lc.fit(docs.unionByName(copies), labels)
    assert seen[0] == seen[1] and np.array_equal(alone.weight, repeated.weight)

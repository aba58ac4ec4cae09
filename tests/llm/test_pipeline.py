import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from sentrymill.llm import line_crf, poisson_mix, spaced_seeds
from sentrymill.session import shared_folder

from . import test_poisson_mix, test_simhash_vp, test_spaced_seeds, test_token_files

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def by_hand(rows, model, items):
    """The five stages in plain Python."""
    rows = [r for r in rows if model.score(pa.array([r[1]], pa.string()))[0] >= line_crf.THRESHOLD]
    component = test_simhash_vp.brute([r[:2] for r in rows])
    smallest = {c for _, _, c in component}
    rows = [r for r in rows if r[0] in smallest]
    long_enough = [(i, t) for i, t in items if len(test_spaced_seeds.words(t)) >= spaced_seeds.ITEM_WORDS]

    def leaks(text):
        own = set(test_spaced_seeds.words(text))
        return any(
            len(own & set(test_spaced_seeds.words(t))) >= 6 and test_spaced_seeds.brute([(0, text)], [(i, t)]) for i, t in long_enough
            if len(own & set(test_spaced_seeds.words(t))) >= 0.6 * len(set(test_spaced_seeds.words(t))) or f" {t[:60].lower()}" in f" {(text or '').lower()}")

    rows = [r for r in rows if not leaks(r[1])]
    copies = test_poisson_mix.brute([(r[0], r[2]) for r in rows])
    text = {r[0]: r[1] for r in rows}
    order = sorted((hashlib.md5(f"{poisson_mix.SEED + 1}:{d}:{k}".encode()).hexdigest()[:16], d) for d, _, k, _ in copies)
    out, at = [], 0
    for _, d in order:
        ids = np.array(test_token_files.whole([text[d] or ""])[0], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return sorted(out)


def test_run_equals_stages_by_hand(spark):
    docs = table(spark, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    model = line_crf.fit(docs, table(spark, "labels"))
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == by_hand(rows, model, items) and len(got) > 50


def test_stages_keep_the_columns(spark):
    docs = table(spark, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]


def test_null_empty_and_repeated_rows_and_empty_tables(spark):
    docs = table(spark, "documents")
    odd = spark.createDataFrame(
        [(900001, None, None, None, None), (900002, "", "en", "src0", 0), (None, "no id", "en", None, 5), (900003, "", "en", "src0", 0)], docs.schema)
    some = docs.unionByName(odd).unionByName(odd).unionByName(docs.where("doc_id < 20"))
    for rows in (some, docs.limit(0)):
        folder = shared_folder(spark, "pipeline-test")
        rows.write.parquet(f"{folder}/documents.parquet")
        for name in ("labels", "benchmark"):
            table(spark, name).write.parquet(f"{folder}/{name}.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert sorted(r.start for r in out) == np.cumsum([0] + [r.n_tokens for r in sorted(out, key=lambda r: r.start)]).tolist()[:len(out)]
        assert bool(out) == (rows is some)


def test_package_root_has_the_pipeline():
    assert os.path.exists(os.path.join(os.path.dirname(corpus_pipeline.__file__), "__spark_entry__.py"))
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "token-ID / binary output"

"""Registered queries of the corpus operators: each over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    digest_index, filter_audit, fuzzy_lines, gru_lm, licenses, line_crf, pii_crf, poisson_mix, quality_rules, simhash_vp,
    spaced_seeds, spelling, token_files,
)

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents")).drop("spans")


def op3_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.benchmark_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.near_duplicate_components(_table(spark, sf_dir, "documents"))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.fuzzy_line_groups(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.judged(docs, quality_rules.fit(docs, _table(spark, sf_dir, "labels")))


def op7_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii_crf.personal_data(docs, pii_crf.fit(docs))


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.replicated(_table(spark, sf_dir, "documents")).select(
        "doc.doc_id", "doc.source", F.round("rate", 9).alias("rate"), "n_copies", "copy", "shuffle_key")


def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return line_crf.scored(docs, line_crf.fit(docs, _table(spark, sf_dir, "labels")))


def op10_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.scored(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return digest_index.exact_duplicates(docs, digest_index.older_half(docs))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_token_files, op2_license_templates, op3_spaced_seeds, op4_simhash_vp, op5_fuzzy_lines, op6_quality_rules,
        op7_pii_crf, op8_poisson_mix, op9_line_crf, op10_gru_lm, op11_filter_audit, op12_digest_index, op13_spelling_variants,
    )}

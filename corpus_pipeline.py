"""From raw documents to token files, in stages that each call one corpus operator.

Each stage reads what the one before wrote and works on all of it. All but the last return the
columns of ``documents``; null texts count as empty, repeated rows are rows of their own (the
near-duplicate stage keeps one of them), and an empty table stays empty through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sentrymill.llm import line_crf, poisson_mix, queries, simhash_vp, spaced_seeds, token_files
from sentrymill.session import delete_folder, scratch, shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the line classifier, fitted on ``labels``, rejects."""
    return line_crf.accepted(docs, line_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest id."""
    return simhash_vp.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that overlap a benchmark item."""
    return spaced_seeds.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents to the target weights of their sources, in a global random order."""
    return poisson_mix.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files in the mixed order and return each document's place in them.

    The order is that of the mixing stage: a digest of id and number of the copy.
    """
    copy = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))) - 1
    return token_files.token_file_digest(
        docs, public_tokenizers.path(queries.TOKENIZER), order=[poisson_mix.shuffle_key(F.col("doc_id"), copy)])


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", encode_tokens),
]

# Trained models, fingerprints and tokenizers are outside SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before wrote. What a stage reads and what
    it keeps for itself is deleted once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = shared_folder(spark, f"pipeline-{k}")
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before is not None:
            delete_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to tokens: five stages, each on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from splitscope.llm import bpe, decontaminate, exact_dedup, language, near_dedup
from splitscope.llm.common import removed, tidied

#: Rank file of the last stage.
RANKS = "byte_bpe_multi_50k.tiktoken"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those whose language the classifier gives less than even odds; without any row to learn
    languages from, nothing."""
    return language.drop_unknown(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the row with the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of similarity 0.8 and more connect."""
    return near_dedup.drop_near_copies(docs, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian unsigned 32-bit integers) and their number, in place of the text."""
    return bpe.token_ids(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("byte_bpe", tokens),
]

#: No SQL: the first stage's classifier and the last one's merges are beyond it. tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage leaves in the shared folder goes with the next one; the last stage's input stays,
    as its result is read from there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = tidied(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if before is not None:
            removed(spark, before)
        before = docs.inputFiles()[0].rpartition("/")[0] if docs.inputFiles() else None
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes all rows that the stage before kept; all but the last return the columns of
``documents``. ``run`` writes each stage's rows as Parquet in the shared folder and rereads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellspark.llm import bpe, decontaminate, minhash, quality_classifier, suffix_dedup
from cellspark.llm.common import bound_batches, read_table, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.keep(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five-word shingles, 80 %) stays."""
    bound_batches(spark)
    return minhash.keep_one(docs, width=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that stand elsewhere in the corpus too go; a document of which nothing is left stays as an empty one."""
    bound_batches(spark)
    return suffix_dedup.strip_repeats(docs, words=51)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of what is left, and the digest of their decoding."""
    bound_batches(spark)
    return bpe.digests(docs)


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("byte_bpe", token_ids),
]

#: Fitted models, components and token ids are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

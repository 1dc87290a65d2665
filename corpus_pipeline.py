"""Training-corpus pipeline: quality rules, exact dedup, SimHash near-dedup, source mixing, BPE coding.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all rows its
predecessor kept. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe_codec, exact_dedup, mixing, quality_rules, simhash
from lodestar.llm.queries import VOCABULARY
from lodestar.session import scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are removed, rejected documents go; ``n_chars`` follows the text."""
    kept = quality_rules.clean(docs)
    return kept.withColumn("n_chars", F.length("text").cast(kept.schema["n_chars"].dataType))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text."""
    path = public_tokenizers.path(VOCABULARY)
    coded = bpe_codec.decode(bpe_codec.encode(docs, path).drop("text"), path)
    return coded.select("doc_id", "lang", "source", "ids", *bpe_codec.digests(coded))


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", bpe_stage),
]

# Min-cost flow cut-offs and BPE merges have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

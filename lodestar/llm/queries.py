"""The registered corpus queries, with the contracts' parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import (bpe_codec, collocations, conversations, exact_dedup, langid, licenses, line_dedup, mixing, pii,
                          quality_rules, simhash, toxicity, url_filter)
from lodestar.llm.common import table

VOCABULARY = "byte_bpe_50k.json"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of ``documents`` that repeat earlier passages of 30 words or more."""
    return line_dedup.repeated_spans(table(spark, sf_dir, "documents")).withColumnRenamed("keep_id", "keep_doc_id")


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained category probabilities of every document, learned from ``labels``."""
    docs = table(spark, sf_dir, "documents")
    models = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.predict(docs, models).withColumn("toxic", F.col("p_toxic") > 0.5)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``; digests of both."""
    path = public_tokenizers.path(VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_codec.decode(bpe_codec.encode(docs, path).drop("text"), path)
    return coded.select("doc_id", *bpe_codec.digests(coded))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of each document."""
    rows = mixing.decisions(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.filter(~held).select("doc_id", "text", "lang"))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate group, survivor and digest of every document."""
    rows = exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"), hash_all=True)
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept_chars", "kept")


def op9_pii_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and discovered spans of personal data in every document."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.concat("base", "added")       # by kind, then start
    return found.select("doc_id", *[count(k) for k in pii.PATTERNS], F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"),
                        pii.span_text(every).alias("spans"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.fit(pages.select("url", "html")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of ``documents``."""
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and repaired text of every conversation after damage."""
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity_chain": op2_toxicity_chain,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_mix_sources": op4_mix_sources,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_language_id": op6_language_id,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_pii_contexts": op9_pii_contexts,
    "op10_url_filter": op10_url_filter,
    "op11_collocations": op11_collocations,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_license_scan": op13_license_scan,
}

"""Relevance annotations and NDCG.

Everything is long-form: annotations are ``(query, url, relevance)`` rows and
predictions ``(query, url, position)`` rows; no per-query map or list is ever
collected. Ranks inside a query are dense positions from a range-partitioned
global order, so one query holding a third of the rows still spreads across
tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import normalize_query
from lodestar.functions.vector import discount, gain
from lodestar.operators.rowid import rank_within


def filter_code_lang(raw: DataFrame, code_lang: str, col: str = "Language") -> DataFrame:
    """Annotation rows of one code language (case-insensitive)."""
    return raw.where(F.lower(F.col(col)) == F.lit(code_lang.lower()))


def mean_relevance(raw: DataFrame, code_lang: str | None = None) -> DataFrame:
    """A1: mean over annotators per (lower-cased stripped query, url).

    Rows with a null query, url or relevance are dropped, as pandas'
    pivot_table drops NaN.
    """
    df = filter_code_lang(raw, code_lang) if code_lang else raw
    return (df.select(normalize_query("Query").alias("query"), F.col("GitHubUrl").alias("url"),
                      F.col("Relevance").cast("double").alias("relevance"))
              .where(F.col("query").isNotNull() & F.col("url").isNotNull() & F.col("relevance").isNotNull())
              .groupBy("query", "url")
              .agg(F.avg("relevance").alias("relevance")))


def relevance_lookup(pairs: DataFrame, annotations: DataFrame, default: float = 0.0) -> DataFrame:
    """A2: relevance of each (query, url) pair; pairs never annotated get ``default``.

    The nested ``{query: {url: rel}}`` mapping with a 0.0 default is a left
    join against the long table, so no per-query map is collected.
    """
    return (pairs.join(annotations.select("query", "url", "relevance"), ["query", "url"], "left")
                 .withColumn("relevance", F.coalesce(F.col("relevance"), F.lit(float(default)))))


def annotated_predictions(predictions: DataFrame, annotations: DataFrame) -> DataFrame:
    """Predictions of annotated queries, left-joined with their annotations."""
    queries = annotations.select("query").distinct()
    return (predictions.join(queries, "query", "left_semi")
                       .join(annotations.select("query", "url", "relevance"), ["query", "url"], "left"))


def queries_without_predictions(predictions: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotated queries for which nothing was predicted."""
    return (annotations.select("query").distinct()
                       .join(predictions.select("query"), "query", "left_anti"))


def dcg_rank(predictions: DataFrame, annotations: DataFrame) -> DataFrame:
    """Rank of each annotated result.

    ``rank_within``: running count of annotated results (unannotated urls take
    no rank); ``rank_all``: the list position. Groups are one query's result
    list (bounded by ``n_results``), so a partitioned window is used.
    """
    joined = annotated_predictions(predictions, annotations)
    w = (Window.partitionBy("query").orderBy("position")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (joined.withColumn("rank_within", F.count("relevance").over(w).cast("bigint"))
                  .where(F.col("relevance").isNotNull())
                  .withColumn("rank_all", F.col("position").cast("bigint")))


def ideal_rank(annotations: DataFrame) -> DataFrame:
    """1-based rank of each annotation by relevance, descending (ties by url)."""
    return rank_within(annotations, ["query"], [F.col("relevance").desc(), F.col("url")], "ideal_rank")


def idcg(annotations: DataFrame) -> DataFrame:
    """Ideal DCG per query over all its annotations (not cut to n_results)."""
    return (ideal_rank(annotations)
            .groupBy("query")
            .agg(F.sum(gain("relevance") * discount("ideal_rank")).alias("idcg")))


def dcg(predictions: DataFrame, annotations: DataFrame, variant: str = "within") -> DataFrame:
    """DCG per annotated query that received predictions."""
    rank = {"within": "rank_within", "all": "rank_all"}[variant]
    ranked = dcg_rank(predictions, annotations)
    return ranked.groupBy("query").agg(F.sum(gain("relevance") * discount(rank)).alias("dcg"))


def ndcg(predictions: DataFrame, annotations: DataFrame, variant: str = "within",
         strict: bool = False) -> DataFrame:
    """Mean NDCG over annotated queries with IDCG > 0 (one row).

    ``variant='within'`` ignores unannotated urls when ranking, ``'all'`` counts
    them. A query without predictions scores 0 unless ``strict`` (then raises).
    No counted query gives NULL.
    """
    if strict:
        missing = queries_without_predictions(predictions, annotations).limit(1).count()
        if missing:
            raise KeyError("an annotated query has no predictions")
    per_query = (idcg(annotations).where(F.col("idcg") > 0)
                 .join(dcg(predictions, annotations, variant), "query", "left")
                 .withColumn("ndcg", F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("idcg")))
    return per_query.agg(F.avg("ndcg").alias(f"ndcg_{variant}"),
                         F.count(F.lit(1)).alias("n_queries"))


def ndcg_both(predictions: DataFrame, annotations: DataFrame) -> DataFrame:
    """A7, both variants in one pass: ``(ndcg_within, ndcg_all, n_queries)``."""
    ranked = dcg_rank(predictions, annotations)
    dcgs = ranked.groupBy("query").agg(
        F.sum(gain("relevance") * discount("rank_within")).alias("dcg_within"),
        F.sum(gain("relevance") * discount("rank_all")).alias("dcg_all"))
    per_query = idcg(annotations).where(F.col("idcg") > 0).join(dcgs, "query", "left")
    return per_query.agg(
        F.avg(F.coalesce(F.col("dcg_within"), F.lit(0.0)) / F.col("idcg")).alias("ndcg_within"),
        F.avg(F.coalesce(F.col("dcg_all"), F.lit(0.0)) / F.col("idcg")).alias("ndcg_all"),
        F.count(F.lit(1)).alias("n_queries"))


def merge_batch_predictions(batched: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Per query keep the predictions of the latest batch (later batches win)."""
    latest = batched.groupBy("query").agg(F.max(batch_col).alias(batch_col))
    return batched.join(latest, ["query", batch_col], "left_semi")

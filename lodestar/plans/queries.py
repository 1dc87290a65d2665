"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the test tables (whole) and runs the library operator on
them. Float outputs are rounded to 6 places so the SQL oracle can compare.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import config
from lodestar.operators import relevance as rel
from lodestar.operators import rowid, scoring, search
from lodestar.plans import fixtures as fx
from lodestar.plans.common import rounded

VALID_POOL = config.BATCH_SIZE        # validation pools are training batches
TEST_POOL = config.MRR_POOL           # 1 + 999 distractors
TINY_ROWS = 150                       # the tiny corpus: fewer rows than any test table


# ---------------------------------------------------------------- scoring ----
def _pooled_pairs(spark: SparkSession, sf_dir: str, pool: int) -> DataFrame:
    t = fx.towers(spark, sf_dir)
    return rowid.assign_batches(t, pool, pos_col="row_id")


def _scores(spark, sf_dir, pool):
    return scoring.batch_query_scores(_pooled_pairs(spark, sf_dir, pool))


def q_pair_scores(spark, sf_dir):
    return rounded(scoring.pair_scores(_pooled_pairs(spark, sf_dir, VALID_POOL)))


def q_hardest_negative(spark, sf_dir):
    return rounded(scoring.hardest_negative(_scores(spark, sf_dir, VALID_POOL)))


def q_pair_loss(spark, sf_dir):
    return rounded(scoring.pair_loss(_scores(spark, sf_dir, VALID_POOL)))


def q_epoch_mean(spark, sf_dir):
    return rounded(scoring.epoch_mean(scoring.pair_loss(_scores(spark, sf_dir, VALID_POOL))))


def q_mrr(spark, sf_dir):
    return rounded(scoring.mrr_by_batch(_scores(spark, sf_dir, VALID_POOL)))


def q_mrr_test_pool(spark, sf_dir):
    return rounded(scoring.mrr(_scores(spark, sf_dir, TEST_POOL)))


def q_query_group_ids(spark, sf_dir):
    s = _scores(spark, sf_dir, VALID_POOL)
    return rowid.query_group_ids(s).select("batch_id", "row_id", "query_group", "rank")


# ----------------------------------------------------------------- search ----
def _knn(spark, sf_dir, k=config.N_RESULTS):
    return search.knn_exact(fx.search_queries(spark, sf_dir), fx.search_corpus(spark, sf_dir), k)


def q_knn_exact(spark, sf_dir):
    return rounded(_knn(spark, sf_dir).select("query_id", "code_id", "position", "score"))


def q_knn_cells(spark, sf_dir):
    """The same answers through pivot cells of 64 codes, whatever the number of queries."""
    hits = search.knn_exact(fx.search_queries(spark, sf_dir), fx.search_corpus(spark, sf_dir), config.N_RESULTS,
                            max_broadcast_queries=0, chunk_rows=64)
    return rounded(hits.select("query_id", "code_id", "position", "score"))


def _predictions(spark, sf_dir):
    hits = _knn(spark, sf_dir)
    named = hits.join(fx.search_queries(spark, sf_dir).select("query_id", "query"), "query_id")
    return (search.resolve_urls(named, fx.search_corpus(spark, sf_dir))
            .select(F.lower(F.col("query")).alias("query"), "url", "position", "query_id"))


def q_topk_results(spark, sf_dir):
    return _predictions(spark, sf_dir).select("query", "url", "position")


def q_take_by_position(spark, sf_dir):
    return _predictions(spark, sf_dir).select("query_id", "position", "url")


def _annotations(spark, sf_dir):
    return rel.mean_relevance(fx.annotation_rows(spark, sf_dir), "python")


def q_mean_relevance(spark, sf_dir):
    return rounded(_annotations(spark, sf_dir))


def q_filter_code_lang(spark, sf_dir):
    raw = fx.annotation_rows(spark, sf_dir)
    return rounded(rel.filter_code_lang(raw, "PYTHON"))


def q_relevance_map(spark, sf_dir):
    preds = _predictions(spark, sf_dir).select("query", "url", "position")
    return rounded(rel.relevance_lookup(preds, _annotations(spark, sf_dir)))


def q_annotated_predictions(spark, sf_dir):
    preds = _predictions(spark, sf_dir).select("query", "url", "position")
    return rounded(rel.annotated_predictions(preds, _annotations(spark, sf_dir)))


def q_queries_without_predictions(spark, sf_dir):
    preds = _predictions(spark, sf_dir).select("query", "url", "position")
    return rel.queries_without_predictions(preds, _annotations(spark, sf_dir))


def q_dcg_rank(spark, sf_dir):
    preds = _predictions(spark, sf_dir).select("query", "url", "position")
    return rounded(rel.dcg_rank(preds, _annotations(spark, sf_dir))
                   .select("query", "url", "position", "relevance", "rank_within", "rank_all"))


def q_ideal_rank(spark, sf_dir):
    return rounded(rel.ideal_rank(_annotations(spark, sf_dir)))


def q_ndcg(spark, sf_dir):
    preds = _predictions(spark, sf_dir).select("query", "url", "position")
    ann = _annotations(spark, sf_dir)
    return rounded(rel.ndcg_both(preds, ann))


def q_merge_batch_predictions(spark, sf_dir):
    """Every query in its own batch, and the lower half of its results in the next one, which wins."""
    preds = _predictions(spark, sf_dir)
    first = preds.withColumn("batch_id", F.expr(f"query_id div {config.BATCH_SIZE}"))
    again = first.where(F.col("position") > config.N_RESULTS // 2).withColumn("batch_id", F.col("batch_id") + 1)
    batched = first.unionByName(again)
    return rel.merge_batch_predictions(batched).select("query", "url", "position", "batch_id")


# ----------------------------------------------------------- rows / splits ----
def q_global_row_id(spark, sf_dir):
    docs = fx.load(spark, sf_dir, "documents").select("doc_id", "lang")
    return rowid.global_row_id(docs, ["lang", "doc_id"], "row_id")


def q_row_pair_alignment(spark, sf_dir):
    return fx.text_pairs(spark, sf_dir).select("row_id", "conv_id", "turn", "url", "query", "code")


def _split_pairs(spark, sf_dir):
    return rowid.split_80_10_10(fx.text_pairs(spark, sf_dir).select("row_id"))


def q_split_80_10_10(spark, sf_dir):
    return _split_pairs(spark, sf_dir).select("row_id", "split", "split_pos")


def q_shuffle_rows(spark, sf_dir):
    return rowid.shuffle_rows(_split_pairs(spark, sf_dir), epoch=0).select("row_id", "split", "shuffle_pos")


def q_assign_batches(spark, sf_dir):
    s = rowid.shuffle_rows(_split_pairs(spark, sf_dir), epoch=0)
    pos = (F.when(F.col("split") == "train", F.col("shuffle_pos")).otherwise(F.col("split_pos")))
    size = F.when(F.col("split") == "test", F.lit(TEST_POOL)).otherwise(F.lit(config.BATCH_SIZE))
    return s.select("row_id", "split", F.floor(pos / size).cast("bigint").alias("batch_id"))


def q_tiny(spark, sf_dir):
    corpus = fx.raw_records(spark, sf_dir).select("row_id", "url")
    return rowid.tiny(corpus, TINY_ROWS)


def q_count_rows(spark, sf_dir):
    docs = fx.load(spark, sf_dir, "documents")
    return docs.agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {
    "pair_scores": q_pair_scores,
    "hardest_negative": q_hardest_negative,
    "pair_loss": q_pair_loss,
    "epoch_mean": q_epoch_mean,
    "mrr": q_mrr,
    "mrr_test_pool": q_mrr_test_pool,
    "query_group_ids": q_query_group_ids,
    "knn_exact": q_knn_exact,
    "knn_cells": q_knn_cells,
    "topk_results": q_topk_results,
    "take_by_position": q_take_by_position,
    "mean_relevance": q_mean_relevance,
    "filter_code_lang": q_filter_code_lang,
    "relevance_map": q_relevance_map,
    "annotated_predictions": q_annotated_predictions,
    "queries_without_predictions": q_queries_without_predictions,
    "dcg_rank": q_dcg_rank,
    "ideal_rank": q_ideal_rank,
    "ndcg": q_ndcg,
    "merge_batch_predictions": q_merge_batch_predictions,
    "global_row_id": q_global_row_id,
    "row_pair_alignment": q_row_pair_alignment,
    "split_80_10_10": q_split_80_10_10,
    "shuffle_rows": q_shuffle_rows,
    "assign_batches": q_assign_batches,
    "tiny": q_tiny,
    "count_rows": q_count_rows,
}

"""In-batch scores, loss and MRR on hand-worked frames (ties, zero vectors, short pools)."""
import math

import numpy as np
import pytest

from lodestar.operators import scoring


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "row_id long, batch_id long, query_vec array<double>, code_vec array<double>")


def test_ranks_and_ties(spark):
    # pool of 3; query 0 is tied between codes 0 and 1 -> smaller id wins the tie
    rows = [(0, 0, [1.0, 0.0], [1.0, 0.0]), (1, 0, [0.0, 1.0], [1.0, 0.0]), (2, 0, [0.0, 1.0], [0.0, 1.0])]
    out = {r["row_id"]: r for r in scoring.batch_query_scores(_pairs(spark, rows)).collect()}
    assert out[0]["rank"] == 1            # tie with code 1, but 0 < 1
    assert out[1]["rank"] == 3            # code 2 scores higher; code 0 ties at 0 and has the smaller id
    assert out[2]["rank"] == 1
    assert out[0]["hardest_negative"] == pytest.approx(1.0)
    assert out[2]["target_score"] == pytest.approx(1.0)


def test_one_row_pool_has_no_negative(spark):
    rows = [(5, 3, [1.0, 2.0], [2.0, 1.0])]
    r = scoring.batch_query_scores(_pairs(spark, rows)).collect()[0]
    assert r["rank"] == 1 and r["hardest_negative"] == 0.0 and r["pool_size"] == 1
    loss = scoring.pair_loss(scoring.batch_query_scores(_pairs(spark, rows))).collect()[0]["loss"]
    assert loss == pytest.approx(1.0 - 0.8)


def test_zero_vector_ranks_last(spark):
    rows = [(0, 0, [0.0, 0.0], [1.0, 0.0]), (1, 0, [1.0, 0.0], [0.0, 0.0]), (2, 0, [1.0, 1.0], [1.0, 1.0])]
    out = {r["row_id"]: r for r in scoring.batch_query_scores(_pairs(spark, rows)).collect()}
    assert out[0]["target_score"] is None or math.isnan(out[0]["target_score"])
    assert out[1]["rank"] == 3            # the zero-vector target scores NULL: every finite code beats it


def test_short_last_pool_and_overall_mean(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i // 4, rng.normal(size=3).tolist(), rng.normal(size=3).tolist()) for i in range(10)]
    scores = scoring.batch_query_scores(_pairs(spark, rows))
    by_batch = {r["batch_id"]: r for r in scoring.mrr_by_batch(scores).collect()}
    assert by_batch[2]["n_queries"] == 2
    overall = scoring.mrr(scores).collect()[0]["mrr"]
    weighted = sum(r["mrr"] * r["n_queries"] for r in by_batch.values()) / 10
    assert overall == pytest.approx(weighted)


def test_numpy_and_sql_expression_agree(spark):
    """Differential: the kernel's cosine equals the JVM higher-order-function form."""
    from pyspark.sql import functions as F

    from lodestar.functions.vector import cosine
    rng = np.random.default_rng(1)
    rows = [(i, 0, rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for i in range(6)]
    df = _pairs(spark, rows)
    sql = {r["row_id"]: r["c"] for r in df.select("row_id", cosine("query_vec", "code_vec").alias("c")).collect()}
    ker = {r["row_id"]: r["target_score"] for r in scoring.batch_query_scores(df).collect()}
    for k in sql:
        assert ker[k] == pytest.approx(sql[k], abs=1e-12)


def test_mrr_known_value_sf001(spark):
    """One pool of 250 pairs at sf0.01 gives the value measured by the plan (0.029459)."""
    from lodestar.plans.queries import q_mrr_test_pool
    from tests.conftest import SF01
    r = q_mrr_test_pool(spark, SF01).collect()[0]
    assert r["mrr"] == pytest.approx(0.029459, abs=1e-6) and r["n_queries"] == 250

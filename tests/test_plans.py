"""Plan invariants of registered queries: no cartesian products, no single-partition windows,
top-k as WindowGroupLimit, scans read only the needed columns."""
import re

import pytest

import __spark_entry__ as entry
from lodestar.plans.queries import QUERIES
from tests.conftest import SF001

KEYS = [*QUERIES, "best_checkpoints", "langid_predict", "word_counts", "knn_approx", "early_stop", "project_field",
        "label_intersection", "corpus_select", "single_line_docstrings", "pair_geometry", "alphabet", "bpe_pair_counts",
        "token_frequency", "mean_pool", "embed_lookup", "nl_labels", "filter_nl", "index_build", "text_stream"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", KEYS)
def test_no_cartesian_or_global_window(spark, key):
    plan = _plan(entry.queries()[key](spark, SF001))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for line in plan.splitlines():
        if "Window " in line or line.strip().startswith("Window"):
            assert "SinglePartition" not in line


def test_topk_uses_window_group_limit(spark):
    assert "WindowGroupLimit" in _plan(entry.queries()["knn_exact"](spark, SF001))


def test_scan_prunes_columns(spark):
    df = entry.queries()["global_row_id"](spark, SF001)
    text = df._jdf.queryExecution().toString()
    assert all("text" not in part.split("\n")[0] for part in text.split("ReadSchema")[1:])
    wc = entry.queries()["word_counts"](spark, SF001)
    formatted = wc._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<text:string>" in formatted


def test_registry_covers_oracles():
    """Every oracle belongs to a query; only the documented keys are rows-only."""
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    rows_only = {k for k in set(qs) - set(sql) if k != "pipeline" and not re.match(r"op\d+_", k)}
    assert rows_only == {"bpe_train", "bpe_encode", "tokenize_fields", "prepare_training", "test_mrr",
                         "validate", "eval_ndcg", "nbow_fit", "search"}
    assert all("round(" not in v or "+ 0.0)" in v for v in sql.values())

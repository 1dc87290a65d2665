"""Q1 with the natural-language filter on, and the searcher's precondition."""
import pytest
from pyspark.sql import functions as F

from lodestar.operators import langid, rowid
from lodestar.plans import fixtures as fx
from lodestar.plans.end_to_end import prepare_corpus
from lodestar.session import scratch_path
from lodestar.sources import files
from tests.conftest import SF001


def test_prepare_corpus_with_language_filter(spark):
    raw = fx.raw_records(spark, SF001)
    split = rowid.split_80_10_10(raw.select("row_id"))
    tagged = raw.join(split.select("row_id", "split"), "row_id").drop("row_id")
    root = scratch_path(spark, "t-q1")
    files.write_splits(tagged, root, "python")
    model = langid.langid_fit(fx.load(spark, SF001, "documents"))
    out = prepare_corpus(spark, root, "python", langs=["english"], langid_model=model)
    rows = out.collect()
    # expected: docstrings (newlines as spaces) predicted English with probability >= 0.5
    docs = raw.select("url", F.regexp_replace("docstring", "\n", " ").alias("d"), "row_id")
    pred = langid.langid_predict(docs, model, "d")
    want = {r["url"] for r in pred.where((F.col("lang_pred") == "en") & (F.col("lang_prob") >= 0.5)).collect()}
    assert {r["url"] for r in rows} == want and len(want) > 0
    assert sorted(r["row_id"] for r in rows) == list(range(len(rows)))
    with pytest.raises(ValueError):
        prepare_corpus(spark, root, "python", langs=["english"])        # no model given


def test_search_without_encoder_raises(spark):
    from lodestar.operators.search import Searcher
    s = Searcher(spark.range(1), spark.range(1))
    with pytest.raises(RuntimeError):
        s.search(spark.range(1))

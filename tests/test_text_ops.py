"""Sources round trips, language id, early stopping, encoder on hand-worked inputs."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import encoder, langid, train
from lodestar.session import scratch_path
from lodestar.sources import files


def test_jsonl_round_trip_and_failfast(spark):
    df = spark.createDataFrame([("u1", "f", ["a", "b"], ["c"], "doc")], files.RAW_SCHEMA)
    p = scratch_path(spark, "t-jsonl")
    files.write_jsonl(df, p)
    assert files.read_jsonl(spark, p, files.RAW_SCHEMA).collect() == df.collect()


def test_queries_keep_blank_lines_and_strip(spark):
    p = scratch_path(spark, "t-lines")
    spark.createDataFrame([("  a b \n\nc",)], "value string").write.text(p)
    assert [r["value"] for r in files.read_queries(spark, p).collect()] == ["a b", "", "c"]


def test_nl_labels_and_unknown():
    assert langid.nl_labels(["english", "FRENCH"]) == ["__label__en", "__label__fr"]
    with pytest.raises(LookupError):
        langid.nl_labels(["klingon"])


def test_langid_threshold_and_short_text(spark):
    train_df = spark.createDataFrame([("en", "the cat sat on the mat with the hat"), ("de", "der hund und die katze")],
                                     "lang string, text string")
    model = langid.langid_fit(train_df)
    probe = spark.createDataFrame([(0, "the hat"), (1, "und die"), (2, "ab")], "row_id long, text string")
    pred = {r["row_id"]: r for r in langid.langid_predict(probe, model, "text").collect()}
    assert pred[0]["lang_pred"] == "en" and pred[1]["lang_pred"] == "de"
    assert pred[2]["lang_pred"] is None
    kept = langid.filter_nl(langid.langid_predict(probe, model, "text"), ["english"], 0.5)
    assert [r["row_id"] for r in kept.collect()] == [0]
    strict = langid.filter_nl(langid.langid_predict(probe, model, "text"), ["english"], 0.999999)
    assert strict.count() <= 1


def test_early_stop_fold(spark):
    vals = [1.0, 0.9, 0.8996, 0.8995, 0.85, 0.86, 0.87, 0.851, 0.8499, 0.9, 1.0]
    hist = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(vals)] + [(2, 1, 1.0), (2, 2, float("nan"))],
                                 "run_id long, epoch long, valid_loss double")
    out = {r["run_id"]: r for r in train.early_stop(hist).collect()}
    # improvements at 1, 2, 5; waits 3,4 (0.8996/0.8995 < 0.9-0.0005? 0.8996 > 0.8995 -> no), ...
    best, wait, stop = math.inf, 0, None
    for e, v in enumerate(vals, 1):
        if v < best - 0.0005:
            best, wait = v, 0
        else:
            wait += 1
            if wait >= 5:
                stop = e
                break
    assert out[1]["stop_epoch"] == stop and out[1]["best_value"] == pytest.approx(best)
    assert out[2]["stop_epoch"] == 2        # non-finite value stops at once


def test_nbow_matches_numpy(spark):
    w = encoder.md5_weights(spark, "shared", 20, 4, 3)
    towers = encoder.load_towers(w)
    ids = [[3, 5, 0, 0], [19, 1, 2, 0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "row_id long, ids array<int>")
    got = {r["row_id"]: r["vec"] for r in encoder.nbow_encode(df, "ids", w).collect()}
    t = towers["shared"]
    assert np.allclose(t.embed[0], 0.0)
    for i, v in enumerate(ids):
        arr = np.array(v)
        pooled = t.embed[arr].sum(axis=0) / len(v)
        h = pooled @ t.fc_w.T + t.fc_b
        h = (h - t.bn_mean) / np.sqrt(t.bn_var + 1e-5) * t.bn_w + t.bn_b
        assert np.allclose(got[i], np.tanh(h))


def test_early_stop_distributed_equals_fold(spark):
    import random
    rnd = random.Random(5)
    rows = []
    for run in range(30):
        v = 1.0
        for e in range(1, rnd.randint(1, 40) + 1):
            v = v - rnd.uniform(-0.01, 0.02) if rnd.random() > 0.02 else float("nan")
            rows.append((run, e, v))
    hist = spark.createDataFrame(rows, "run_id long, epoch long, valid_loss double")
    a = sorted(tuple(r) for r in train.early_stop(hist).collect())
    b = sorted(tuple(r) for r in train.early_stop_fold(hist).collect())
    assert [x[:3] + (x[4],) for x in a] == [x[:3] + (x[4],) for x in b]
    for x, y in zip(a, b):
        assert (x[3] is None and y[3] is None) or x[3] == pytest.approx(y[3])


def test_kernels_hold_a_slice_of_a_batch():
    """Pooling 4,000 rows of 200 tokens takes memory of a slice, and a batch of long texts is counted in several runs."""
    import tracemalloc

    import pyarrow as pa
    rng = np.random.default_rng(0)
    tower = encoder.Tower({"embed": rng.normal(size=(50, 32)), **{n: np.ones((32, 32)) for n in ("fc_weight", "fc_bias", "bn_mean", "bn_var", "bn_weight", "bn_bias")}})
    ids = rng.integers(0, 50, size=(4000, 200))
    tracemalloc.start()
    pooled = tower.pool(ids)
    assert tracemalloc.get_traced_memory()[1] < 50e6           # the whole batch's states: 205 MB
    tracemalloc.stop()
    assert np.array_equal(pooled[17], tower.embed[ids[17]].sum(axis=0) / 200)
    texts = pa.array(["abc" * n for n in (10, 400_000, 5)] + [None, ""] + ["xyz " * 200_000] * 3)
    runs = list(langid._slices(texts))
    assert [i for r in runs for i in range(r.start, r.stop)] == list(range(8)) and len(runs) > 3


def test_trigram_counts_add_up_over_slices():
    codes = langid._codes("banana bandana")
    grams, counts = langid._added(*[np.unique(c, return_counts=True) for c in (codes[:5], codes[5:])])
    whole = np.unique(codes, return_counts=True)
    assert np.array_equal(grams, whole[0]) and np.array_equal(counts, whole[1])
    none = np.unique(codes[:0], return_counts=True)
    assert len(langid._added(none, none)[0]) == 0


def test_split_directories_are_projected_after_the_split(spark, monkeypatch):
    """Texts are joined with their split before they are tokenized: no token array is persisted."""
    from lodestar.plans import fixtures, queries_text
    docs = spark.createDataFrame([(i, "src", f"word{i} x, y") for i in range(20)] + [(20, None, None)], "doc_id long, source string, text string")
    monkeypatch.setattr(fixtures, "load", lambda *a: docs)
    write, seen = files.write_splits, []
    monkeypatch.setattr(files, "write_splits", lambda df, *a, **kw: (seen.append(df.columns), write(df, *a, **kw)))
    root = scratch_path(spark, "t-splits")
    queries_text._write_raw_splits(spark, "", root)
    assert sorted(seen[0]) == ["doc_id", "source", "split", "text"]
    back = files.scan_splits(spark, root, "python").drop("split", "split_order")
    key = lambda r: int(r["url"])
    assert sorted(back.collect(), key=key) == sorted(fixtures.raw_fields(docs).drop("row_id").collect(), key=key)

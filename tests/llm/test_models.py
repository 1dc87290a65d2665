"""Language ID and toxicity: held-out accuracy, defined results, the kernels against plain forms."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import langid, linear, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_ftrl_separates():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(600):
        y = int(rng.integers(3))
        rows.append((np.array([y, 3 + int(rng.integers(4))]), np.ones(2), y))
    w = linear.train(rows, 7, 3, linear.Ftrl(alpha=0.5, l1=0.1))
    assert all(linear.logits(w, i, v).argmax() == y for i, v, y in rows)
    heavy = linear.train(rows, 7, 3, linear.Ftrl(alpha=0.5, l1=1e6))
    assert not heavy.any()


def test_temperature_is_the_minimum():
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 3, 400)
    scores = rng.normal(size=(400, 3)) * 6
    scores[np.arange(400), labels] += 4
    loss = lambda t: -np.log(linear.softmax(scores / t)[np.arange(400), labels]).mean()
    t = linear.temperature(scores, labels)
    assert loss(t) <= min(loss(x) for x in np.geomspace(0.06, 19, 300)) + 1e-9


def test_ngrams_of_blocks_are_those_of_the_whole(monkeypatch):
    text = "Hello wörld, the quick brown fox. " * 50
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "_BLOCK", 37)
    parts = langid.ngram_counts(text)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    assert langid.ngram_counts("a,b")[1].sum() == 5 + 4 + 3          # " a b " has so many 1-, 2-, 3-grams


def test_document_frequency(rows):
    df, n = langid.document_frequency(rows.select("text"))
    texts = [r.text for r in rows.collect() if langid.has_letter(r.text)]
    want = np.zeros_like(df)
    for t in texts:
        want[langid.ngram_counts(t)[0]] += 1
    assert n == len(texts) and np.array_equal(df, want)


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op6_language_id(spark, SF).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.lang]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_awkward_rows(rows, clashing, empty):
    model = langid.fit(rows.select("doc_id", "text", "lang"))
    got = langid.predict(clashing.select("doc_id", "text", "kept"), model).collect()
    assert len(got) == rows.count()
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (3, 4, 5)) and r.kept == "x"
    assert langid.fit(empty.select("doc_id", "text", "lang")) is None
    assert langid.fit(rows.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))) is None
    assert {r.lang_pred for r in langid.predict(rows.select("doc_id", "text"), None).collect()} == {"und"}
    assert langid.predict(empty.select("doc_id", "text"), model).count() == 0


def test_chain_on_held_out_rows(spark):
    """Fit without a fifth of the labels; the toxic ones among them are found."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    outside = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    models = toxicity.fit(docs, labels.filter(~outside))
    test = labels.filter(outside)
    got = toxicity.predict(docs.join(test, "doc_id", "left_semi"), models).join(test, "doc_id").collect()
    hits = sum(r.toxic == 1 and r.p_toxic > 0.5 for r in got)
    assert hits / sum(r.toxic == 1 for r in got) > 0.85
    assert hits / max(1, sum(r.p_toxic > 0.5 for r in got)) > 0.95


def test_out_of_fold_probabilities():
    """A fold's rows are scored by the model that never saw them; the chain's slots follow the words."""
    import pandas as pd
    part = pd.DataFrame({"k": range(50), "i": [np.array([n % 2], np.int32) for n in range(50)],
                         "y": [[float(n % 2), 0.0] for n in range(50)], "before": [[]] * 50})
    out = toxicity._learner(0, 5, 4, 18, linear.Ftrl())((2,), part)
    assert sorted(out["k"]) == [k for k in range(50) if k % 5 == 2]
    w = linear.train([(np.array([n % 2], np.int32), np.ones(1), n % 2) for n in range(50) if n % 5 != 2], 18, 2, linear.Ftrl())
    assert all(b[0] == pytest.approx(toxicity._probability(w, np.array([k % 2]), np.ones(1))) for k, b in zip(out["k"], out["before"]))
    index, value = toxicity._with_chain(np.array([1, 3]), [0.25], 4)
    assert index.tolist() == [1, 3, 16] and value.tolist() == [1.0, 1.0, 0.25]


def test_toxicity_of_awkward_rows(spark, rows, clashing, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 0), (6, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    models = toxicity.fit(clashing, labels)
    got = toxicity.predict(clashing, models).collect()
    assert len(got) == rows.count() and all(0 <= r.p_toxic <= 1 and 0 <= r.p_quality <= 1 for r in got)
    none = toxicity.fit(rows, labels.limit(0))
    assert none == [None, None]
    assert {r.p_toxic for r in toxicity.predict(rows, none).collect()} == {0.5}
    assert toxicity.predict(empty, models).count() == 0 and toxicity.fit(empty, labels) == [None, None]


def test_small_samples_are_calibrated_by_the_same_rule(spark):
    """One row of each language is always learned from; otherwise rows are held back by hash at every size."""
    texts = {"en": "the cat and the dog of the house", "de": "der Hund und die Katze im Haus", "fr": "le chien et le chat de la maison"}
    for n in (1, 5, 17, 40):
        rows = [(k * 3 + j, f"{t} {k}", lang) for k in range(n) for j, (lang, t) in enumerate(texts.items())]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = langid.fit(docs)
        got = langid.predict(docs.select("doc_id", "text"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
        assert len(got) == 3 * n and sum(r.lang_pred == r.lang for r in got) >= 0.9 * len(got)

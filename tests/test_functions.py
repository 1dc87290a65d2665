"""Scalar Column functions (C1-C14, B1) and the passage containment scan."""
import math

import pytest
from pyspark.sql import functions as F

from lodestar import functions as fn


def _one(spark, col, schema="x string", value=("x",)):
    return spark.createDataFrame([value], schema).select(col.alias("out")).first()["out"]


def test_text_functions(spark):
    assert _one(spark, fn.capitalize("x"), value=("javaSCRIPT",)) == "Javascript"
    assert _one(spark, fn.strip("x"), value=("\t a b \n",)) == "a b"
    assert _one(spark, fn.normalize_query("x"), value=("  Sort List ",)) == "sort list"
    assert _one(spark, fn.strip_newlines("x"), value=("a\nb",)) == "a b"
    assert _one(spark, fn.first_line("x"), value=("first\nsecond",)) == "first"
    assert _one(spark, fn.join_tokens(F.array(F.lit("a"), F.lit("b")))) == "a b"
    assert _one(spark, fn.nl_key(F.array(F.lit("en"), F.lit("fr")))) == "en_fr"
    assert _one(spark, fn.nl_key(F.array().cast("array<string>"))) == "all"
    assert fn.nl_key_of(None) == "all" and fn.nl_key_of(["de"]) == "de"


def test_pretokens_split_words_and_punctuation(spark):
    toks = _one(spark, fn.pretokens("x"), value=("def f(x):  return x_1+2 ÉtÉ",))
    assert toks == ["def", "f", "(", "x", "):", "return", "x_1", "+", "2", "ÉtÉ"]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(fn.l2_norm("a").alias("n"), fn.cosine("a", "b").alias("c"), fn.cosine("a", "z").alias("cz"),
                  fn.angular_distance(fn.cosine("a", "a")).alias("ad"), fn.angular_distance(fn.cosine("a", "z")).alias("az"), fn.relu(F.lit(-2.0)).alias("r"),
                  fn.gain(F.lit(2.0)).alias("g"), fn.discount(F.lit(3)).alias("d")).first()
    assert r["n"] == pytest.approx(5.0) and r["c"] == pytest.approx(24 / 25)
    assert r["cz"] is None and r["az"] is None   # zero vector: NULL, not an error
    assert r["ad"] == pytest.approx(0.0, abs=1e-7) and r["r"] == 0.0
    assert r["g"] == 3.0 and r["d"] == pytest.approx(1 / math.log2(4))


def test_hash_uniform_matches_python(spark):
    import hashlib
    u = _one(spark, fn.hash_uniform(F.lit("123456:7")))
    assert u == int(hashlib.md5(b"123456:7").hexdigest()[:8], 16) / 2 ** 32


def test_passages_in_documents(spark):
    from lodestar.operators.containment import passages_in_documents
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "lazy dog"), (3, None)], "doc_id long, text string")
    ps = spark.createDataFrame([(10, "quick brown"), (11, "dog"), (12, "cat"), (13, "quick brown")],
                               "item_id long, text string")
    got = sorted(map(tuple, passages_in_documents(docs, ps).collect()))
    assert got == [(1, 10), (1, 13), (2, 11)]


def test_corpus_helpers(spark):
    from lodestar.operators import corpus
    df = spark.createDataFrame([(1, "c1", "q1"), (2, "c2", "q2")], "row_id long, code string, query string")
    assert corpus.project_field(df, "code").columns == ["row_id", "text"]
    other = spark.range(1)
    assert corpus.corpus_select(True, df, other) is df and corpus.corpus_select(False, df, other) is other
    stream = sorted(map(tuple, corpus.text_stream(df).collect()))
    assert stream == [(1, "code", "c1"), (1, "query", "q1"), (2, "code", "c2"), (2, "query", "q2")]
    aligned = corpus.align_pairs(df.select("row_id", "code"), df.select("row_id", "query"))
    assert sorted(map(tuple, aligned.collect())) == [(1, "c1", "q1"), (2, "c2", "q2")]
    labels = spark.createDataFrame([(["__label__en"],), (["__label__de"],)], "p array<string>")
    wanted = F.array(F.lit("__label__en"), F.lit("__label__fr"))
    assert [r[0] for r in labels.select(corpus.label_intersection(F.col("p"), wanted)).collect()] == [True, False]

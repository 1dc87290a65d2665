import pytest


@pytest.fixture
def rows(spark):
    """Documents that hold the awkward cases: nulls, blanks, long texts, ties, repeats, clashing columns."""
    long_text = " ".join(f"w{i % 97}x{i % 31}" for i in range(40_000))
    data = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda.", "en", "a", 3),
        (2, "Alpha  beta gamma delta epsilon zeta eta theta iota kappa lambda.", "en", "b", 3),
        (2, "Alpha  beta gamma delta epsilon zeta eta theta iota kappa lambda.", "en", "b", 3),
        (3, None, None, None, None),
        (4, "", "de", "a", 0),
        (5, " \t\n", "de", "c", 3),
        (6, long_text, "en", "a", 9),
        (7, long_text + " tail", "en", "b", 9),
        (None, "no id here, but a few words to read anyway today.", "fr", "c", 1),
        (8, "<|endoftext|> don't  stop 12.5 km 日本 été \U0001F600", "fr", "c", 1),
    ]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def clashing(rows):
    """The same rows with extra columns whose names the operators use for their own."""
    from pyspark.sql import functions as F
    for c in ("kept", "_len", "_all", "_id", "size", "key", "fp", "ids", "component", "pattern", "_text"):
        rows = rows.withColumn(c, F.lit("x"))
    return rows


@pytest.fixture
def empty(rows):
    return rows.limit(0)

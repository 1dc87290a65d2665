"""Stand-in inputs built from the test tables.

These only reshape the given tables into the schemas the jobs expect; the
jobs themselves do not rely on how the rows were derived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import pretokens
from lodestar.operators.rowid import global_row_id
from lodestar.session import ship_package


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a user turn and the assistant turn right after it.

    ``(row_id, conv_id, turn, url, query, code)``; ``row_id`` is dense by
    (conv_id, turn). The "next turn" is found with a dense global order and an
    equi-join on ``id + 1`` (no per-conversation window, so one huge
    conversation does not land in one task).
    """
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ordered = global_row_id(conv, ["conv_id", "turn"], "_g")
    nxt = ordered.select((F.col("_g") - 1).alias("_g"), F.col("conv_id").alias("_nconv"),
                         F.col("role").alias("_nrole"), F.col("text").alias("code"))
    pairs = (ordered.where(F.col("role") == "user")
                    .join(nxt, "_g")
                    .where((F.col("_nconv") == F.col("conv_id")) & (F.col("_nrole") == "assistant"))
                    .select("conv_id", "turn", F.col("text").alias("query"), "code",
                            F.concat_ws("/", F.col("conv_id").cast("string"),
                                        F.col("turn").cast("string")).alias("url")))
    return global_row_id(pairs, ["conv_id", "turn"], "row_id")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 raw form: one raw training record per document.

    ``url, func_name, code_tokens, docstring_tokens, docstring, row_id``.
    """
    return raw_fields(load(spark, sf_dir, "documents"))


def raw_fields(docs: DataFrame) -> DataFrame:
    """The raw training records of document rows."""
    return docs.select(
        F.col("doc_id").cast("string").alias("url"),
        F.col("source").alias("func_name"),
        pretokens("text").alias("code_tokens"),
        pretokens("text").alias("docstring_tokens"),
        F.col("text").alias("docstring"),
        F.col("doc_id").cast("long").alias("row_id"),
    )


def definition_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 definitions form (S6): ``url, identifier, function_tokens, docstring_tokens``."""
    return raw_records(spark, sf_dir).select(
        "url", F.col("func_name").alias("identifier"),
        F.col("code_tokens").alias("function_tokens"), "docstring_tokens", "row_id")


def towers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs of vectors; pair ``vec_id div 2``, side 0 = query, side 1 = code.

    ``(row_id, query_vec, code_vec, query_label, code_label)``.
    """
    e = load(spark, sf_dir, "embeddings")
    side = F.col("vec_id") % 2
    return (e.groupBy(F.expr("vec_id div 2").alias("row_id"))
             .agg(F.first(F.when(side == 0, F.col("embedding")), ignorenulls=True).alias("query_vec"),
                  F.first(F.when(side == 1, F.col("embedding")), ignorenulls=True).alias("code_vec"),
                  F.first(F.when(side == 0, F.col("label")), ignorenulls=True).alias("query_label"),
                  F.first(F.when(side == 1, F.col("label")), ignorenulls=True).alias("code_label"))
             .where(F.col("query_vec").isNotNull() & F.col("code_vec").isNotNull()))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 queries: every query-side vector, ``(query_id, query, vec, label)``."""
    t = towers(spark, sf_dir)
    return t.select(F.col("row_id").alias("query_id"),
                    F.concat(F.lit("Query "), F.col("row_id").cast("string")).alias("query"),
                    F.col("query_vec").alias("vec"), F.col("query_label").alias("label"))


def search_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 corpus: every code-side vector, ``(code_id, url, vec, label)``."""
    t = towers(spark, sf_dir)
    return t.select(F.col("row_id").alias("code_id"),
                    F.concat(F.lit("vec/"), F.col("row_id").cast("string")).alias("url"),
                    F.col("code_vec").alias("vec"), F.col("code_label").alias("label"))


def annotation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw relevance annotations in the CSV layout.

    Each query pair p is judged against the codes of pairs p-1, p and p+1:
    grade 3 for equal labels, 1 for labels one apart, else 0. Two annotators:
    ``grade`` and ``greatest(grade - 1, 0)``, one of whom writes the language in
    lower case. Equal labels are also judged for another language, and for a
    query that nobody searches.
    """
    t = towers(spark, sf_dir)
    q = t.select(F.col("row_id").alias("q"), F.col("query_label").alias("ql"))
    c = t.select(F.col("row_id").alias("c"), F.col("code_label").alias("cl"))
    judged = (q.withColumn("c", F.explode(F.array(F.col("q") - 1, F.col("q"), F.col("q") + 1)))
               .join(c, "c"))
    diff = F.abs(F.col("ql") - F.col("cl"))
    grade = F.when(diff == 0, F.lit(3)).when(diff == 1, F.lit(1)).otherwise(F.lit(0))
    base = judged.select(
        F.lit("Python").alias("Language"),
        F.concat(F.lit("Query "), F.col("q").cast("string")).alias("Query"),
        F.concat(F.lit("vec/"), F.col("c").cast("string")).alias("GitHubUrl"),
        grade.alias("g"))
    second = F.greatest(F.col("g") - 1, F.lit(0))
    votes = F.array(*[F.struct(lang.alias("Language"), query.alias("Query"), "GitHubUrl", g.cast("double").alias("Relevance"))
                      for lang, query, g in (
                          (F.col("Language"), F.col("Query"), F.col("g")),
                          (F.lower("Language"), F.col("Query"), second),
                          (F.lit("Java"), F.col("Query"), F.when(F.col("g") == 3, F.lit(2))),
                          (F.col("Language"), F.concat(F.lit("Unsearched "), F.col("Query")), F.when(F.col("g") == 3, F.lit(1))))])
    return base.select(F.inline(votes)).where(F.col("Relevance").isNotNull())


def metric_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as validation histories: run = user, epoch = 1-based order
    by (ts, event_id) inside the user, ``valid_loss = value / 100``."""
    from lodestar.operators.rowid import rank_within
    ev = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    ranked = rank_within(ev, ["user_id"], ["ts", "event_id"], "epoch")
    return ranked.select(F.col("user_id").alias("run_id"), "epoch",
                         (F.col("value") / F.lit(100.0)).alias("valid_loss"))


def text_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2 over F1: every query and code text as one ``text`` column."""
    from lodestar.operators.corpus import text_stream as stream
    return stream(text_pairs(spark, sf_dir), ("code", "query"))

"""Which documents contain which passages: an equi-join on one word of each passage, then an exact check.

A passage's words other than its first and last stand between white space
wherever the passage occurs, so a document that contains it holds the longest
of them as a word. Documents and passages meet on that word only; the pairs are
then checked by ``contains``. Passages of fewer than three words meet documents
on their first characters instead. Nothing is broadcast by hand and no size is
refused: both sides may grow, and adaptive execution splits a word that many
documents share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRAM = 3       # characters on which short passages meet documents


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), 0)


def _longest(words: Column) -> Column:
    ranked = F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    return F.array_max(ranked)["w"]


def _grams(text: Column, n: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1))


def passages_in_documents(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id",
                          doc_text: str = "text", passage_id: str = "item_id",
                          passage_text: str = "text") -> DataFrame:
    """``(doc_id, passage_id)`` for every passage occurring (exactly) in a document.

    Null and empty passages occur nowhere; repeated rows count once.
    """
    texts = docs.select(F.col(doc_id).alias("_d"), F.col(doc_text).alias("_t")).where("_t is not null")
    sought = (passages.select(F.col(passage_id).alias("_p"), F.col(passage_text).alias("_q")).where("length(_q) > 0")
              .withColumn("_w", _words(F.col("_q"))))
    inner = F.slice("_w", F.lit(2), F.size("_w") - 2)
    long_ones = sought.where(F.size("_w") > 2).select("_p", "_q", _longest(inner).alias("_k"))
    held = texts.select("_d", F.explode(F.array_distinct(_words(F.col("_t")))).alias("_k"))
    pairs = held.join(long_ones, "_k").select("_d", "_p", "_q")
    short = sought.where(F.size("_w") <= 2).select("_p", "_q", F.least(F.length("_q"), F.lit(_GRAM)).alias("_n"))
    for n in sorted(r["_n"] for r in short.select("_n").distinct().collect()):      # at most _GRAM values
        grams = texts.select("_d", F.explode(_grams(F.col("_t"), n)).alias("_k"))
        mine = short.where(F.col("_n") == n).select("_p", "_q", F.substring("_q", 1, n).alias("_k"))
        pairs = pairs.unionByName(grams.join(mine, "_k").select("_d", "_p", "_q"))
    return (texts.join(pairs, "_d").where(F.contains("_t", "_q"))
            .select(F.col("_d").alias(doc_id), F.col("_p").alias(passage_id)).distinct())

"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after deleting ASCII white space. Only rows that
still share their length with another row are grouped by a hash of a short
prefix, and only rows that still share that are hashed in full. Each round is a
map-side-combined count; its surviving keys come back as a bitmap of 16 slots a key
(broadcast up to 32 MB, joined by page beyond), and
no text is ever shuffled to decide. A false positive of the bitmap only means
that one more row is hashed in full; the last round groups by the full hash, so
the result is exact.

DataFrame functions only. Defined results: a null text counts as empty; all
empty texts are one group. Of equal texts the row with the most code points in
the original stays, then the smallest doc_id (null last); of rows that are still
tied (repeated doc_id) exactly one stays. Extra columns pass through
``drop_duplicates`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import KeySet, flag_members, key_set, pinned, without_whitespace

PREFIX_CHARS = 64


def _keyed(df: DataFrame, text_col: str, prefix_chars: int) -> DataFrame:
    """Add the normalised text and the keys of the first two rounds."""
    norm = F.col("_norm")
    return (df.withColumn("_norm", without_whitespace(F.col(text_col)))
              .withColumn("_len", F.length(norm).cast("long"))
              .withColumn("_prefix", F.xxhash64(F.substring(norm, 1, prefix_chars))))


def surviving_keys(df: DataFrame, text_col: str = "text", prefix_chars: int = PREFIX_CHARS,
                   filter_bits: int | None = None) -> KeySet:
    """Bitmap of the (length, prefix hash) keys that more than one row has."""
    keys = pinned(_keyed(df.select(text_col), text_col, prefix_chars).select("_len", "_prefix"))
    shared = lambda d, cols: d.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    by_length = key_set(shared(keys, ["_len"]), ["_len"], filter_bits)
    still = flag_members(keys, by_length, "_again").filter("_again")
    return key_set(shared(still, ["_len", "_prefix"]), ["_len", "_prefix"], filter_bits)


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False,
                     prefix_chars: int = PREFIX_CHARS, filter_bits: int | None = None) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``text_sha256`` is the full hash; rows that dropped out of the refinement
    earlier have none, unless ``hash_all`` asks for it.
    """
    keys = surviving_keys(df, text_col, prefix_chars, filter_bits)
    rows = flag_members(_keyed(df.select(id_col, text_col), text_col, prefix_chars), keys, "_candidate")
    full = F.sha2(F.col("_norm"), 256)
    rows = pinned(rows.select(
        F.col(id_col), F.col("_candidate"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("_chars"),
        (full if hash_all else F.when(F.col("_candidate"), full)).alias("text_sha256"),
        F.monotonically_increasing_id().alias("_row")))     # the checkpoint pins these numbers
    rank = F.struct((-F.col("_chars")).alias("c"), F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"),
                    F.col("_row").alias("r"))
    groups = (rows.filter("_candidate").groupBy("text_sha256")
              .agg(F.min(rank).alias("_best"), F.count(F.lit(1)).alias("group_size")))
    # A derived key gives the join an exchange of its own on both sides, which
    # adaptive execution can split when one group of copies is large.
    groups = groups.select(F.concat(F.col("text_sha256"), F.lit("")).alias("_sha"), "_best", "group_size")
    several = (rows.filter("_candidate").join(groups, F.col("text_sha256") == F.col("_sha"))
               .select(id_col, F.col("_best.i").alias("keep_id"), "group_size",
                       (F.col("_row") == F.col("_best.r")).alias("kept"), "text_sha256"))
    single = rows.filter(~F.col("_candidate")).select(
        id_col, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    return several.unionByName(single)


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    prefix_chars: int = PREFIX_CHARS, filter_bits: int | None = None) -> DataFrame:
    """The rows of ``df`` that stay, all columns kept.

    Rows that share no key pass without a shuffle; candidates are combined per
    full hash on the map side first, so a hot group sends one row per task.
    """
    names = df.columns
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_all"),
                       F.col(text_col).alias("_text"), F.col(id_col).alias("_id"))
    keys = surviving_keys(df, text_col, prefix_chars, filter_bits)
    rows = flag_members(_keyed(packed, "_text", prefix_chars), keys, "_candidate")
    single = rows.filter(~F.col("_candidate")).select("_all.*")
    rank = F.struct((-F.length(F.coalesce(F.col("_text"), F.lit("")))).alias("c"), F.col("_id").isNull().alias("n"),
                    F.col("_id").alias("i"), F.xxhash64("_all").alias("h"))
    best = (rows.filter("_candidate").groupBy(F.sha2(F.col("_norm"), 256).alias("_sha"))
            .agg(F.min_by("_all", rank).alias("_all")).select("_all.*"))
    return single.unionByName(best)

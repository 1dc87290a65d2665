"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32 bits. If two
fingerprints differ in at most three bits, one segment differs in at most one.
Each segment is indexed under its exact value and, for every bit, under the
value with that bit as a wildcard; the equality join on these keys meets a pair
either at the exact key or at the one wildcard where the two bits differ. The
rest of the fingerprints is then verified by popcount.

Only distinct fingerprints take part; copies are classes with their smallest
doc_id as representative. A key that very many fingerprints share (a hot
bucket) is indexed once more, by the deletion variants of the two 16-bit halves
of the other segment, before it is joined: its members have at most three bits
to differ there too, so the same argument holds and no pair is lost. Within
such a bucket at most 2**16 distinct values share a key again, however large
the input is.

Defined results: null and blank texts have fingerprint zero and link like any
other; a text of fewer words than the shingle is hashed as a whole; rows without
doc_id take part in links, and a component's id is its smallest non-null doc_id
(null if there is none). Repeated rows and ties share a fingerprint and so a
component. Extra columns are ignored by ``near_duplicates`` and pass through
``drop_near_duplicates`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import flag_members, key_set, pinned, small_batches
from lodestar.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
HASH_SEED = 42
HOT_BUCKET = 256          # fingerprints under one key beyond which it is indexed again


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """64-bit SimHash, as a signed integer, of the ASCII-lower-cased words' shingles."""
    words = (text or "").encode().lower().split()      # bytes: A-Z and the six white-space characters only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        hashes = [digest(joined, seed)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes) - 1
        starts = ends - sizes + 1
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts[:len(words) - shingle + 1].tolist(),
                                                             ends[shingle - 1:].tolist())]
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):                       # bounds the bit matrix of a very long text
        block = hashes[at:at + 8192]
        bits = np.unpackbits(np.frombuffer(b"".join(block), np.uint8).reshape(len(block), 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    value = int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")
    return value - (1 << 64) if value >> 63 else value


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS,
                 seed: int = HASH_SEED) -> DataFrame:
    """``(id_col, fp)`` of every row; no shuffle."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _variants(value: Column, bits: int, tag: int) -> Column:
    """Index entries of a segment value: (key, side). The exact key has side 2; the
    wildcard key of bit i has side 0 or 1, the bit that was deleted."""
    exact = F.struct((value + F.lit((tag * 64 + 63) << 32)).alias("key"), F.lit(2).alias("side"))
    wild = [F.struct((value.bitwiseAND(F.lit(~(1 << i) & ((1 << bits) - 1))) + F.lit((tag * 64 + i) << 32)).alias("key"),
                     F.shiftright(value, i).bitwiseAND(F.lit(1)).cast("int").alias("side")) for i in range(bits)]
    return F.array(exact, *wild)


def _segments(fp: Column, bits: int, count: int) -> list[Column]:
    return [F.shiftrightunsigned(fp, bits * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(count)]


def _meet(index: DataFrame, keys: list[str], max_bits: int) -> DataFrame:
    """Equality join of an index on ``keys``, opposite sides of a wildcard or two exact entries, verified."""
    left = index.filter("side <> 1").select(*keys, F.col("fp").alias("a"), F.col("side").alias("s"))
    right = index.filter("side <> 0").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("fp").alias("b"),
                                             F.col("side").alias("t"))
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    on = same[0] if len(same) == 1 else same[0] & same[1]
    fits = ((F.col("s") == 0) & (F.col("t") == 1)) | ((F.col("s") == 2) & (F.col("t") == 2) & (F.col("a") < F.col("b")))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return left.join(right, on).filter(fits & close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(distinct: DataFrame, max_bits: int = MAX_BITS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints at ``max_bits`` (at most 3) or fewer differing bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with one wildcard serve at most three differing bits")
    low, high = _segments(F.col("fp"), 32, 2)
    index = (distinct.select("fp", F.explode(F.concat(_variants(low, 32, 0), _variants(high, 32, 1))).alias("e"))
             .select("fp", "e.key", "e.side"))
    # Only keys that can hold a pair go on: both sides of a wildcard, or two exact entries.
    counts = (index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi"))
              .filter("n > 1 and (lo <> hi or lo = 2)")
              .select((F.col("key") + F.lit(0)).alias("_key"), "n"))
    shared = pinned(index.join(counts, F.col("key") == F.col("_key")).select("fp", "key", "side", "n"))
    cold = _meet(shared.filter(F.col("n") <= hot_bucket), ["key"], max_bits)
    hot = shared.filter(F.col("n") > hot_bucket)
    # The key fixes one segment up to its wildcard; the other one is indexed by its halves.
    in_low = F.shiftright("key", 38) == 0
    other = F.when(in_low, high).otherwise(low)
    first, second = _segments(other, 16, 2)
    again = (hot.select("fp", "key", "side", F.explode(F.concat(_variants(first, 16, 0), _variants(second, 16, 1))).alias("e"))
             .select("fp", "key", F.col("side").alias("outer"), F.col("e.key").alias("sub"), "e.side"))
    warm = _meet_again(again, max_bits)
    return cold.union(warm).distinct()


def _meet_again(index: DataFrame, max_bits: int) -> DataFrame:
    """Second-level join inside hot buckets: equal sub-keys, the two conditions of both levels."""
    pair = lambda s, t: ((F.col(s) != F.col(t)) & (F.col(s) != 2) & (F.col(t) != 2)) | ((F.col(s) == 2) & (F.col(t) == 2))
    left = index.select("key", "sub", F.col("fp").alias("a"), F.col("outer").alias("o1"), F.col("side").alias("s1"))
    right = index.select(F.col("key").alias("_key"), F.col("sub").alias("_sub"), F.col("fp").alias("b"),
                         F.col("outer").alias("o2"), F.col("side").alias("s2"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return (left.join(right, (F.col("key") == F.col("_key")) & (F.col("sub") == F.col("_sub")))
            .filter((F.col("a") < F.col("b")) & pair("o1", "o2") & pair("s1", "s2") & close).select("a", "b"))


def _labelled(fps: DataFrame, max_bits: int, hot_bucket: int) -> DataFrame:
    """``(fp, root, component)`` of every distinct fingerprint; the root tells components apart whatever their ids."""
    classes = pinned(fps.groupBy("fp").agg(F.min("id").alias("rep")))
    # Nodes are fingerprints: they exist even where every doc_id of a class is null.
    nodes = components(links(classes.select("fp"), max_bits, hot_bucket))
    member = classes.join(nodes, classes["fp"] == nodes["node"], "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("root"))
    lowest = member.groupBy("root").agg(F.min("rep").alias("component"))
    lowest = lowest.select((F.col("root") + F.lit(0)).alias("_root"), "component")
    return (member.join(lowest, F.col("root") == F.col("_root"))
            .select((F.col("fp") + F.lit(0)).alias("_fp"), "root", "component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS, seed: int = HASH_SEED, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """One row per input row: ``id_col``, ``fingerprint`` (16 hex digits), ``component_id``."""
    fps = pinned(fingerprints(df, id_col, text_col, shingle, seed))
    labelled = _labelled(fps, max_bits, hot_bucket)
    return fps.join(labelled, F.col("fp") == F.col("_fp")).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS,
                         max_bits: int = MAX_BITS, seed: int = HASH_SEED, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """One row of each component, its smallest doc_id; the input's columns.

    Rows are told apart by doc_id and fingerprint, so unrelated texts that share
    a doc_id are judged each. Rows outside any group pass without a shuffle (a
    fixed-size bitmap of the grouped ids tells most of them); the others are
    fingerprinted again and joined with the decisions, of repeated rows one
    stays. A row without doc_id has no decision of its own and stays.
    """
    fps = pinned(fingerprints(df, id_col, text_col, shingle, seed))
    labelled = _labelled(fps, max_bits, hot_bucket)
    groups = pinned(fps.join(labelled, F.col("fp") == F.col("_fp")).select(F.col("id").alias("_id"), "fp", "root", "component"))
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    grouped = (groups.join(sizes.select((F.col("root") + F.lit(0)).alias("_r")), F.col("root") == F.col("_r"))
               .filter("_id is not null")
               .select("_id", F.col("fp").alias("_fp"), "root", (F.col("_id") == F.col("component")).alias("lowest")).distinct())
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"), F.col(id_col).alias("_id"))
    packed = flag_members(packed, key_set(grouped, ["_id"]), "_grouped")
    alone = packed.filter("not _grouped or _id is null").select("_all.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(text_col).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([fingerprint(t, shingle, seed) for t in texts], pa.int64())],
                                             names=["_all", "id", "fp"])

    maybe = packed.filter("_grouped and _id is not null").select("_all", F.col("_id").alias("id"))
    maybe = maybe.mapInArrow(run, T.StructType([*maybe.schema.fields, T.StructField("fp", T.LongType())]))
    judged = maybe.join(grouped, (F.col("id") == F.col("_id")) & (F.col("fp") == F.col("_fp")), "left")
    alone = alone.unionByName(judged.filter("root is null").select("_all.*"))
    one = judged.filter("lowest").groupBy("root").agg(F.min_by("_all", F.xxhash64("_all")).alias("_all")).select("_all.*")
    return alone.unionByName(one)

"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import checkpoint_root

# --- fixed values -----------------------------------------------------------
WHITESPACE = " \t\n\x0b\f\r"                # the characters of [\x20\x09-\x0D]
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
# ---------------------------------------------------------------------------

BATCH_ROWS = 256          # rows per Arrow batch: whole texts, so batches stay a few MB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch: a Python kernel holds one batch of whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def pinned(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the cluster's shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    A column that several higher-order functions mention is otherwise computed
    again for each mention, or even for each array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Whitespace-separated words; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), 0)


def without_whitespace(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITESPACE, "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


_PAGE = 15                # bits of a bitmap page: Spark's bitmaps hold 32768 bits


def _slot(cols: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << bits)).cast("long")


@dataclass(frozen=True)
class KeySet:
    """Bitmap pages of key hashes, one row of 4 KB each: it may hold more keys than it was given, never less."""
    pages: DataFrame
    cols: tuple[str, ...]
    bits: int


def key_set(keys: DataFrame, cols: list[str], bits: int | None = None) -> KeySet:
    """The keys as a bitmap of 16 slots a key, counted first (``bits`` overrides the size)."""
    held = pinned(keys.select(*cols))
    bits = bits or min(bits_for(held.count()), 40)
    slot = _slot([F.col(c) for c in cols], bits)
    pages = (held.select(slot.alias("_s")).groupBy(F.shiftright("_s", _PAGE).alias("_page"))
             .agg(F.bitmap_construct_agg(F.col("_s").bitwiseAND(F.lit((1 << _PAGE) - 1))).alias("_bits")))
    return KeySet(pages, tuple(cols), bits)


def flag_members(df: DataFrame, keys: KeySet, flag: str) -> DataFrame:
    """Add ``flag``: may the row's key be among those of the set?

    No shuffle of ``df`` while the bitmap has ``2 ** MAX_BITS`` bits (32 MB) at most; a larger one is joined by page.
    """
    inside = F.col("_slot").bitwiseAND(F.lit((1 << _PAGE) - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(inside, 3) + 1, 1)), 16, 10).cast("long")
    hit = F.getbit(byte, inside.bitwiseAND(F.lit(7))) == 1
    pages = F.broadcast(keys.pages) if keys.bits <= MAX_BITS else keys.pages
    return (df.withColumn("_slot", _slot([F.col(c) for c in keys.cols], keys.bits))
              .withColumn("_page", F.shiftright("_slot", _PAGE))
              .join(pages, "_page", "left")
              .withColumn(flag, F.coalesce(hit, F.lit(False)))
              .drop("_page", "_slot", "_bits"))


def bits_for(n_keys: int) -> int:
    """Bits that address 16 slots a key."""
    return max(_PAGE, (16 * n_keys).bit_length())


MAX_BITS = 28             # a bitmap that every task holds has 2**28 bits (32 MB) at most

# --- bitmaps for Python kernels ----------------------------------------------


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Bitmap:
    """Set of evenly spread 64-bit numbers by their upper ``bits`` bits; it may hold more, never less."""
    bits: int
    data: np.ndarray

    def holds(self, numbers: np.ndarray) -> np.ndarray:
        slot = (numbers >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.data[slot >> 3] >> (slot & 7).astype(np.uint8)) & np.uint8(1) == 1


def collect_bitmap(keys: DataFrame, col: str, width: int = 64) -> Bitmap:
    """Bitmap of the ``width``-bit numbers in ``col``; the frame is read twice, so pin it.

    At most ``2 ** (MAX_BITS - 15)`` pages of 4 KB reach the driver.
    """
    bits = min(bits_for(keys.count()), MAX_BITS)
    slot = F.shiftrightunsigned(F.col(col), width - bits)
    pages = (keys.select(slot.alias("_s")).groupBy(F.shiftright("_s", _PAGE).alias("page"))
             .agg(F.bitmap_construct_agg(F.col("_s").bitwiseAND(F.lit((1 << _PAGE) - 1))).alias("bits")))
    data = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (_PAGE - 3)
    for row in pages.collect():
        data[row["page"] * size:(row["page"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return Bitmap(bits, data)

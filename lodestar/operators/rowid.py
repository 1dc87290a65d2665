"""Dense row ids, hash-ordered splits, shuffles and batches.

Nothing here uses an unpartitioned window: a total order is produced by range
partitioning, a checkpoint pins the per-partition order, and only one small
row per partition (its row count) reaches the driver. Hash orders need no global sort: a histogram of
hash prefixes gives every bucket its first position. A shuffled order is a permutation that each row computes for itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar import config
from lodestar.functions.text import hash_order_key
from lodestar.session import checkpoint_root

_LOCAL_BITS = 33   # monotonically_increasing_id keeps the row index in the low 33 bits


def _cols(cols: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def once(df: DataFrame) -> DataFrame:
    """A frame that is cheap to read twice: plain scans as they are, anything computed pinned by a checkpoint."""
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = {line.strip(" :+-").split(" ")[0] for line in plan.toString().splitlines() if line.strip()}
    if nodes <= _SCANS and plan.deterministic():
        return df
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


_SCANS = {"Project", "Filter", "Relation", "LogicalRDD", "LocalRelation", "Range"}
_PART_ROWS = 1 << 20          # rows of a range partition; small tables use the cores


def _ordered(df: DataFrame, order: Sequence[Column | str], num_partitions: int | None) -> DataFrame:
    """Rows range partitioned and sorted, with ``_pid`` and ``_local`` (partition, place in it), pinned."""
    spark = df.sparkSession
    checkpoint_root(spark)
    df = once(df)                                  # range sampling reads the input a second time
    n = num_partitions or max(spark.sparkContext.defaultParallelism, df.count() // _PART_ROWS)
    keys = _cols(order)
    return (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
              .withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
              .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))).drop("_mid"))


def global_row_id(df: DataFrame, order: Sequence[Column | str], id_col: str = "row_id",
                  num_partitions: int | None = None) -> DataFrame:
    """G1: a dense 0-based BIGINT id following a total order.

    ``order`` must be a total order (add a unique tie-breaker). The input is evaluated once, range
    partitioned on the order (hot keys spread across ranges because the key is
    unique), sorted inside each partition, tagged, and checkpointed so a lost
    executor recomputes exactly the same ids. The number of partitions follows from the number of rows.
    Partition row counts (one row
    per partition) give the offsets, which join back as a broadcast table
    whose size is bounded by the partition count.
    """
    tagged = _ordered(df, order, num_partitions)
    counts = sorted((r["_pid"], r["count"]) for r in tagged.groupBy("_pid").count().collect())
    offsets, running = [], 0
    for pid, cnt in counts:
        offsets.append((int(pid), running))
        running += int(cnt)
    off_df = df.sparkSession.createDataFrame(offsets, "_pid long, _offset long")
    return (tagged.join(F.broadcast(off_df), "_pid")
                  .withColumn(id_col, (F.col("_offset") + F.col("_local")).cast("bigint"))
                  .drop("_pid", "_local", "_offset"))


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; nulls are equal."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.xor(pc.is_null(a), pc.is_null(b)), pc.fill_null(pc.not_equal(a, b), False))
    return differ.to_numpy(zero_copy_only=False)


def _local_ranks(group_cols: Sequence[str]):
    """Kernel over sorted partitions: place in the group so far, and whether the row belongs to the partition's first group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, first = None, 0, True
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            columns = [batch.column(c) for c in group_cols]
            starts = np.zeros(n, bool)
            for c in columns:
                starts[1:] |= _changes(c)
            starts[0] = last is not None and last != [c[0].as_py() for c in columns]
            begun = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
            rank = np.where(begun >= 0, np.arange(n) - begun + 1, np.arange(n) + 1 + count)
            opened = (begun < 0) & first
            last, count, first = [c[n - 1].as_py() for c in columns], int(rank[-1]), bool(opened[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank, pa.int64()), pa.array(opened)],
                                             names=[*batch.schema.names, "_rank", "_open"])
    return run


def rank_within(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column | str],
                rank_col: str) -> DataFrame:
    """Dense 1-based rank inside each group without a per-group window and without a join on the group.

    Rows are sorted over the whole table, so a group is a run of rows that may span partitions. A row's rank is its
    place in the run within its partition; rows of a partition's first run add what earlier partitions
    hold of that group. That carry is one number per partition.
    """
    ordered = _ordered(df, [*group_cols, *order], None)
    schema = T.StructType([*ordered.schema.fields, T.StructField("_rank", T.LongType()), T.StructField("_open", T.BooleanType())])
    ranked = ordered.mapInArrow(_local_ranks(list(group_cols)), schema)
    key = F.struct(*group_cols)
    edges = ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"), F.count_if("_open").alias("open"),
                                       F.min_by(key, "_local").alias("head"), F.max_by(key, "_local").alias("tail"),
                                       F.max_by("_rank", "_local").alias("end")).collect()      # one row a partition
    carries, carry, before = [], 0, None
    for e in sorted(edges, key=lambda r: r["_pid"]):
        carry = carry if before is not None and before == e["head"] else 0
        carries.append((e["_pid"], carry))
        carry = e["end"] + (carry if e["open"] == e["n"] else 0)
        before = e["tail"]
    table = df.sparkSession.createDataFrame(carries, "_pid long, _carry long")
    rank = F.col("_rank") + F.when(F.col("_open"), F.col("_carry")).otherwise(0)
    return (ranked.join(F.broadcast(table), "_pid").withColumn(rank_col, rank.cast("bigint"))
                  .drop("_pid", "_local", "_rank", "_open", "_carry"))


def split_sizes(n: int, fractions: Sequence[float] = config.DATA_SPLITS) -> list[int]:
    """T2 sizes: ``int(p*N)`` each, the remainder goes to the first (train)."""
    sizes = [int(p * n) for p in fractions]
    sizes[0] += n - sum(sizes)
    return sizes


def _hash_ranks(df: DataFrame, key: Column, id_col: str, rank_col: str) -> DataFrame:
    """0-based position of each row in the order ``key, id_col``, where ``key`` is an md5 hex string.

    Keys spread evenly, so their first ``_HASH_DIGITS`` digits are buckets of equal size: a row's position is the
    number of rows in lower buckets (a histogram of 16**4 counts at most) plus its place in its own.
    """
    keyed = df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, _HASH_DIGITS))
    counts = {r["_bucket"]: r["count"] for r in keyed.groupBy("_bucket").count().collect()}
    below, table = 0, []
    for bucket in sorted(counts):
        table.append((bucket, below))
        below += counts[bucket]
    offsets = df.sparkSession.createDataFrame(table, "_bucket string, _below long")
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", id_col)) - 1
    return (keyed.withColumn("_place", place).join(F.broadcast(offsets), "_bucket")
                 .withColumn(rank_col, F.col("_below") + F.col("_place")).drop("_key", "_bucket", "_place", "_below"))


_HASH_DIGITS = 4


def split_80_10_10(df: DataFrame, id_col: str = "row_id", seed: int = config.SEED,
                   names: Sequence[str] = config.SPLIT_NAMES,
                   fractions: Sequence[float] = config.DATA_SPLITS) -> DataFrame:
    """Exact-size random split by a seeded hash order.

    Adds ``split`` and ``split_pos`` (0-based position inside the split in the
    hash order, which is also the unshuffled loader order). The input is evaluated once; no global sort.
    """
    df = once(df)
    sizes = split_sizes(df.count(), fractions)
    ranked = _hash_ranks(df, hash_order_key(seed, F.col(id_col)), id_col, "_hpos")
    starts, acc = [], 0
    for s in sizes:
        starts.append(acc)
        acc += s
    split = F.lit(names[-1])
    start = F.lit(starts[-1])
    for name, s0, size in reversed(list(zip(names[:-1], starts[:-1], sizes[:-1]))):
        cond = (F.col("_hpos") >= s0) & (F.col("_hpos") < s0 + size)
        split = F.when(cond, F.lit(name)).otherwise(split)
        start = F.when(cond, F.lit(s0)).otherwise(start)
    return (ranked.withColumn("split", split)
                  .withColumn("split_pos", (F.col("_hpos") - start).cast("bigint"))
                  .drop("_hpos"))


WALKS = 32                   # see permuted
ROUNDS = 4


def permuted(pos: Column, size: Column, *seed: Column) -> Column:
    """A keyed permutation of ``0 .. size - 1`` as an expression of each position by itself.

    A Feistel network over pairs: ``pos = left * b + right`` with ``a = ceil(sqrt(size))``, ``b = ceil(size / a)``; rounds
    in turn add md5 values of one side (and the seed) to the other, modulo its range. That permutes ``a * b >= size``
    numbers; a result of ``size`` or more is sent through again (cycle walking). Fewer than ``a`` numbers
    lie beyond, so a walk ends within ``a`` steps; ``WALKS`` steps are all for sizes up to about 1000, and beyond
    that a longer walk has a chance of less than 10**-48.
    """
    def value(r: int, side: Column) -> Column:
        text = F.concat_ws(":", *[s.cast("string") for s in seed], F.lit(str(r)), side.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")

    def once_through(x: Column) -> Column:
        def rounds(pair: Column, r: int) -> Column:
            if r == ROUNDS:
                return pair["l"] * b + pair["r"]
            after = (F.struct(F.pmod(pair["l"] + value(r, pair["r"]), a).alias("l"), pair["r"].alias("r")) if r % 2 == 0
                     else F.struct(pair["l"].alias("l"), F.pmod(pair["r"] + value(r, pair["l"]), b).alias("r")))
            return F.element_at(F.transform(F.array(after), lambda p: rounds(p, r + 1)), 1)      # evaluated once

        first = F.struct(F.floor(x / b).cast("bigint").alias("l"), F.pmod(x, b).alias("r"))
        return F.element_at(F.transform(F.array(first), lambda p: rounds(p, 0)), 1)

    n = size.cast("bigint")
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("bigint"), F.lit(1).cast("bigint"))
    b = F.greatest(F.ceil(n / a).cast("bigint"), F.lit(1).cast("bigint"))
    walk = F.sequence(F.lit(2), F.lit(WALKS))
    return F.aggregate(walk, once_through(pos.cast("bigint")), lambda x, _: F.when(x < n, x).otherwise(once_through(x)))


def shuffle_rows(df: DataFrame, epoch: int, id_col: str = "row_id", seed: int = config.SEED,
                 partition_col: str | None = "split", pos_col: str = "shuffle_pos", from_col: str | None = None) -> DataFrame:
    """Seeded, engine-independent random order per epoch.

    ``pos_col`` is a permutation of the dense positions ``from_col`` inside ``partition_col`` (``split_pos`` of
    T2, or the dense row id without a partition column); each row computes its own, so no row moves.
    The sizes are one row per group value.
    """
    pos = F.col(from_col or ("split_pos" if partition_col else id_col))
    if partition_col is None:
        return df.withColumn(pos_col, permuted(pos, F.lit(df.count()), F.lit(seed), F.lit(epoch)))
    sizes = {r[0]: r[1] for r in df.groupBy(partition_col).count().collect()}
    if not sizes:
        return df.withColumn(pos_col, F.lit(None).cast("bigint"))
    size = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col(partition_col)]
    return df.withColumn(pos_col, permuted(pos, size, F.lit(seed), F.lit(epoch), F.col(partition_col)))


def assign_batches(df: DataFrame, batch_size: int, pos_col: str = "split_pos",
                   batch_col: str = "batch_id") -> DataFrame:
    """Sequential batches of ``batch_size``; the last one may be short."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    return df.withColumn(batch_col, F.floor(F.col(pos_col) / F.lit(batch_size)).cast("bigint"))


def query_group_ids(df: DataFrame, id_col: str = "row_id", group_col: str = "query_group") -> DataFrame:
    """One group id per query, unique across batches: the row id itself."""
    return df.withColumn(group_col, F.col(id_col).cast("bigint"))


def tiny(df: DataFrame, n: int = config.TINY_SIZE, id_col: str = "row_id") -> DataFrame:
    """The first ``n`` rows in corpus order (TakeOrderedAndProject)."""
    return df.orderBy(F.col(id_col)).limit(n)


def count_rows(df: DataFrame) -> int:
    """Dataset size."""
    return df.count()

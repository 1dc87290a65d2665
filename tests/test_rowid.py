"""Dense ids, splits, shuffles and batches: invariants and independence of partitioning."""
from pyspark.sql import functions as F

from lodestar.operators import rowid


def test_global_row_id_dense_and_partition_independent(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"))
    a = {r["k"]: r["row_id"] for r in rowid.global_row_id(df.repartition(1), ["k"]).collect()}
    b = {r["k"]: r["row_id"] for r in rowid.global_row_id(df.repartition(64), ["k"]).collect()}
    assert a == b and sorted(a.values()) == list(range(1000)) and all(a[k] == k for k in a)


def test_split_sizes_and_disjointness(spark):
    assert rowid.split_sizes(233) == [187, 23, 23]
    assert sum(rowid.split_sizes(7)) == 7
    df = spark.range(0, 101).withColumnRenamed("id", "row_id")
    s = rowid.split_80_10_10(df).collect()
    sizes = {n: sum(1 for r in s if r["split"] == n) for n in ("train", "valid", "test")}
    assert sizes == {"train": 81, "valid": 10, "test": 10}
    for name in sizes:
        assert sorted(r["split_pos"] for r in s if r["split"] == name) == list(range(sizes[name]))


def test_shuffle_changes_with_epoch_and_batches_are_short_at_end(spark):
    df = rowid.split_80_10_10(spark.range(0, 55).withColumnRenamed("id", "row_id"))
    e0 = {r["row_id"]: r["shuffle_pos"] for r in rowid.shuffle_rows(df, 0).collect()}
    e1 = {r["row_id"]: r["shuffle_pos"] for r in rowid.shuffle_rows(df, 1).collect()}
    assert e0 != e1
    b = rowid.assign_batches(rowid.shuffle_rows(df, 0).where("split = 'train'"), 10, "shuffle_pos")
    counts = sorted(r["count"] for r in b.groupBy("batch_id").count().collect())
    assert counts == [5, 10, 10, 10, 10]


def test_tiny_takes_first_rows(spark):
    df = spark.range(0, 50).withColumnRenamed("id", "row_id").repartition(5)
    assert [r["row_id"] for r in rowid.tiny(df, 7).collect()] == list(range(7))


def test_ranks_in_groups_that_span_partitions_and_batches(spark):
    from pyspark.sql import Window
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 7}", i * 37 % 501) for i in range(501)]
    df = spark.createDataFrame(rows, "g string, k long").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {r["k"]: r["rank"] for r in rowid.rank_within(df, ["g"], ["k"], "rank").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert got == {r["k"]: r["w"] for r in want.collect()}
    assert rowid.rank_within(df.limit(0), ["g"], ["k"], "rank").collect() == []


def test_rank_has_no_join_on_the_group(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "g string, k long")
    plan = rowid.rank_within(df, ["g"], ["k"], "rank")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 5, 7, 10, 31, 64, 65, 1000, 4099):
        df = spark.range(n).withColumnRenamed("id", "row_id")
        for epoch in (0, 1):
            got = [r["shuffle_pos"] for r in rowid.shuffle_rows(df, epoch, partition_col=None).collect()]
            assert sorted(got) == list(range(n))
    assert rowid.shuffle_rows(spark.range(0).withColumnRenamed("id", "row_id"), 0, partition_col=None).collect() == []


def test_shuffled_order_moves_no_row(spark):
    df = rowid.split_80_10_10(spark.range(0, 300).withColumnRenamed("id", "row_id")).checkpoint()
    out = rowid.shuffle_rows(df, 0)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    for split, n in (("train", 240), ("valid", 30), ("test", 30)):
        assert sorted(r["shuffle_pos"] for r in out.where(F.col("split") == split).collect()) == list(range(n))


def test_inputs_are_evaluated_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    df = spark.range(0, 400, 1, 4).withColumnRenamed("id", "row_id").mapInPandas(counted, "row_id long")
    for run in (lambda: rowid.global_row_id(df, ["row_id"], "n"), lambda: rowid.split_80_10_10(df),
                lambda: rowid.rank_within(df.withColumn("g", F.col("row_id") % 3), ["g"], ["row_id"], "r")):
        before = seen.value
        assert run().count() == 400
        assert seen.value - before == 400

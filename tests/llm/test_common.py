"""Membership bitmaps: sized by their keys, broadcast or joined, never without a key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import common


@pytest.mark.parametrize("bound", [28, 10])
def test_flags_hold_every_key_and_few_others(spark, monkeypatch, bound):
    monkeypatch.setattr(common, "MAX_BITS", bound)           # 10: the pages are joined, not broadcast
    keys = common.key_set(spark.range(0, 60_000, 3), ["id"])
    assert keys.bits == common.bits_for(20_000) == 19
    flagged = common.flag_members(spark.range(60_000).withColumn("x", F.lit("kept")), keys, "near")
    assert ("strategy=broadcast" in flagged._jdf.queryExecution().analyzed().toString()) == (bound == 28)
    near = {r["id"] for r in flagged.filter("near").collect()}
    assert flagged.columns == ["id", "x", "near"] and flagged.count() == 60_000
    assert near >= set(range(0, 60_000, 3)) and len(near) < 20_000 + 0.15 * 40_000


def test_a_full_bitmap_only_lets_more_through(spark):
    keys = common.key_set(spark.range(0, 200_000, 2), ["id"], bits=15)
    assert common.flag_members(spark.range(1000), keys, "near").filter("near and id % 2 = 0").count() == 500


def test_collected_bitmap(spark):
    numbers = common.spread(np.arange(5000, dtype=np.uint64))
    df = spark.createDataFrame([(int(x),) for x in numbers.view(np.int64)], "k long")
    bitmap = common.collect_bitmap(df, "k")
    assert bitmap.holds(numbers).all()
    assert bitmap.holds(common.spread(np.arange(5000, 55_000, dtype=np.uint64))).mean() < 0.1
    assert not common.collect_bitmap(df.limit(0), "k").holds(numbers).any()

"""The join that splits heavy keys."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinetable.operators.skew import heavy_keys, split_join


@pytest.fixture(scope="module")
def tables(spark):
    """A third of all rows have key 7, a fifth have no key."""
    large = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 5 == 1, F.lit(None)).otherwise(F.col("id") % 900 + 10).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(7, "seven"), (None, "none"), (10, "a"), (10, "b"), (5000, "x")], "k long, name string")
    return large, small


def test_heavy_keys_are_those_above_an_average_partition(spark, tables):
    large, _ = tables
    heavy = heavy_keys(large, ["k"], parts=12)
    by_hash = {r[0]: r[1] for r in large.groupBy(F.xxhash64("k")).count().collect()}
    assert set(heavy) == {h for h, n in by_hash.items() if n * 12 > 30000} and sorted(heavy.values()) == [2, 4]
    assert heavy_keys(large.limit(0), ["k"]) == {}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_equals_plain_null_safe_join(tables, how):
    large, small = tables
    want = large.alias("l").join(small.alias("s"), F.col("l.k").eqNullSafe(F.col("s.k")), how)
    want = want.select("l.k", "l.v", *(["s.name"] if how in ("inner", "left") else []))
    got = split_join(large, small, ["k"], how)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_no_task_holds_a_heavy_key(spark, tables):
    large, small = tables
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sizes = [r[1] for r in split_join(large, small, ["k"], "left").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) >= 30000 and max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]


def test_refuses_joins_that_keep_the_repeated_side(tables):
    with pytest.raises(ValueError):
        split_join(*tables, ["k"], "right")

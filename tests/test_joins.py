"""Joins with very frequent keys give the rows of a plain join."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from trailmark.operators.joins import frequent_keys, join_by_key


@contextmanager
def settings(spark, **wanted):
    names = {k.replace("__", "."): v for k, v in wanted.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def tables(spark):
    # A third of all rows on one key, a third without a key, copies among them.
    left = spark.range(0, 3000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        (F.col("id") % 7).alias("v"),
    )
    right = spark.range(0, 40).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("w"))
    return left, right.unionByName(spark.createDataFrame([("hot", -1), ("unused", -2)], right.schema))


def rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("how", ["left", "left_anti", "left_semi", "inner"])
@pytest.mark.parametrize("partitions", ["1", "2", "4", "400"])
@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_same_rows_as_a_plain_join(spark, tables, how, partitions, broadcast):
    left, right = tables
    columns = ["k", "v"] if how in ("left_anti", "left_semi") else ["k", "v", "w"]
    with settings(spark, spark__sql__autoBroadcastJoinThreshold=broadcast, spark__sql__shuffle__partitions=partitions):
        got = rows(join_by_key(left, right, "k", how), columns)
        assert got == rows(left.join(right, "k", how), columns)


def test_frequent_keys_have_a_task_share(spark, tables):
    left, _ = tables
    for parts, expected in (("1", []), ("4", ["hot"]), ("90", ["hot"])):
        with settings(spark, spark__sql__shuffle__partitions=parts):
            assert frequent_keys(left, "k") == expected
    with settings(spark, spark__sql__shuffle__partitions="400"):
        assert len(frequent_keys(left, "k")) == 51
    assert frequent_keys(left.where("false"), "k") == []


def test_a_hot_key_is_spread_over_tasks(spark, tables):
    left, right = tables
    half = left.where("k is not null").unionByName(left.where("k = 'hot'"))  # half of all rows on one key
    off = {"spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__enabled": "false", "spark__sql__shuffle__partitions": "8"}
    with settings(spark, **off):
        for rows_, key in ((left, "k = 'hot'"), (left, "k IS NULL"), (half, "k = 'hot'")):
            joined = join_by_key(rows_, right, "k", "left").withColumn("task", F.spark_partition_id())
            per_task = [r["count"] for r in joined.where(key).groupBy("task").count().collect()]
            assert len(per_task) >= 5 and max(per_task) < 700

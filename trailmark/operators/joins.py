"""Joining a table to a keyed table when some keys are very frequent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY, _RIGHT = "_join_key", "_right_key"


def frequent_keys(df: DataFrame, key: str) -> list:
    """Keys that alone have at least a task's share of all rows.

    The share is the number of rows over the number of shuffle partitions, so there are no more such keys than
    partitions.  One pass with a sketch whose size follows from that number; it misses no such key, and the counts
    that decide are never too low.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tracked = 1 << (4 * parts).bit_length()
    named = df.where(F.col(key).isNotNull()).select(F.col(key))
    found = named.agg(F.expr(f"approx_top_k({key}, {min(parts, tracked)}, {tracked})").alias("top"), F.count("*").alias("n")).first()
    return [x.item for x in found.top if parts > 1 and x["count"] * parts >= found.n and x["count"] > 1]


def _spread(key: Column, columns: list[str]) -> Column:
    """The key, or for a missing one a text that matches nothing and differs from row to row.

    It comes from the row's content and its partition, so it is the same when a lost task runs again, and copies of
    one row still spread.
    """
    noise = F.xxhash64(*columns) + F.spark_partition_id()
    return F.coalesce(key, F.concat(F.lit("\0"), noise.cast("string")))


def _plain(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Join on the key itself, which the right side may already be partitioned by."""
    spread = left.withColumn(_KEY, _spread(F.col(key), left.columns))
    other = right.withColumnRenamed(key, _RIGHT)
    return spread.join(other, F.col(_KEY) == F.col(_RIGHT), how).drop(_KEY, _RIGHT)


def join_by_key(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """``left`` joined to ``right``, which has at most one row per text ``key``; inner, left, semi or anti.

    Rows of the left's frequent keys meet their right rows by broadcast: at most one row for each shuffle partition.
    All others are joined by the key, rows with a NULL key spread over all tasks.
    """
    hot = frequent_keys(left, key)
    if not hot:
        return _plain(left, right, key, how)
    is_hot = F.col(key).isin(*hot)
    rest = _plain(left.where(~F.coalesce(is_hot, F.lit(False))), right, key, how)
    return rest.unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how).select(*rest.columns))

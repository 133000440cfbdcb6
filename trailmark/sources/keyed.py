"""Keyed tables and version retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str = "key", stamp: str = "updated_at") -> DataFrame:
    """The newest row per key; on equal times the row itself decides, so the order of rows does not matter."""
    rest = [c for c in rows.columns if c not in (key, stamp)]
    newest = F.max(F.struct(stamp, *rest)).alias("row")
    return rows.groupBy(key).agg(newest).select(key, *[F.col(f"row.{c}").alias(c) for c in [stamp, *rest]])


def upsert_latest(old: DataFrame, new: DataFrame, key: str = "key", stamp: str = "updated_at") -> DataFrame:
    """A table with one row per key, as ``latest`` makes it, brought up to date by new rows.

    Only the new rows are reduced; a row of the old table stays unless the new one of its key is as new or newer.  Rows
    with a NULL key are one key.
    """
    rest = [c for c in old.columns if c != key]
    found = latest(new, key, stamp).select(F.col(key).alias("_key"), F.struct(*rest).alias("_new"))
    both = old.withColumn("_old", F.struct(*rest)).select(F.col(key), "_old").join(found, F.col(key).eqNullSafe(F.col("_key")), "full")
    kept = F.col("_old").isNotNull() & (F.col("_new").isNull() | ~F.coalesce(F.col(f"_new.{stamp}") >= F.col(f"_old.{stamp}"), F.col(f"_old.{stamp}").isNull()))
    row = F.when(kept, F.col("_old")).otherwise(F.col("_new"))
    named = both.select(F.when(F.col("_old").isNotNull(), F.col(key)).otherwise(F.col("_key")).alias(key), row.alias("_row"))
    return named.select(key, *[F.col(f"_row.{c}").alias(c) for c in [stamp, *[c for c in rest if c != stamp]]])


def retain_versions(df: DataFrame, version: str, keep: int) -> DataFrame:
    """Rows of the newest ``keep`` versions; the broadcast side has ``keep`` rows."""
    newest = df.select(version).distinct().orderBy(F.desc(version)).limit(keep)
    return df.join(F.broadcast(newest), version, "left_semi")

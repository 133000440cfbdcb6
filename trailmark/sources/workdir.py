"""Where intermediate tables go."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


@functools.cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="trailmark-")


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach, as named by the cluster.

    Only a local session may go without the setting; it gets a folder of its own.
    """
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder all executors reach")
    return _local_folder(spark.sparkContext.applicationId)


def new_folder(spark: SparkSession, name: str, below: str | None = None) -> str:
    """A fresh folder below the shared one, or below a folder of the caller."""
    return f"{(below or shared_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str, below: str | None = None) -> DataFrame:
    """The rows written to the shared folder and read back: worked out once, and safe when executors are lost.

    Who names the folder ``below`` which they are written may remove it once nothing reads them any more.
    """
    folder = new_folder(rows.sparkSession, name, below)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)

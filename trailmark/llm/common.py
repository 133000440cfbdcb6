"""Shared helpers: tables, scratch tables, packed arrays, case."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.sources.workdir import new_folder

#: White space that parts words, as a character class of Java and DuckDB patterns.
BLANKS = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The frame written to the shared folder and read back: cuts lineage, survives lost executors.

    Who names the folder may remove it once all that reads the table is stored itself.
    """
    spark = df.sparkSession
    folder = folder or new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """Words between ASCII white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def pack(values: np.ndarray, level: int = 1) -> bytes:
    """An array as compressed bytes."""
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True) if raw else b"")


def unpack(blob: bytes, kind: str) -> np.ndarray:
    """The array of ``pack``."""
    blob = bytes(blob)
    size = int.from_bytes(blob[:8], "little")
    return np.frombuffer(pa.decompress(blob[8:], size, codec="zstd", asbytes=True) if size else b"", kind)


def pack_words(items: list[bytes], level: int = 1) -> bytes:
    """Byte strings as one blob."""
    sizes = pack(np.fromiter(map(len, items), "u4", len(items)), level)
    return len(sizes).to_bytes(8, "little") + sizes + pack(np.frombuffer(b"".join(items), "u1"), level)


def unpack_words(blob: bytes) -> list[bytes]:
    """The byte strings of ``pack_words``."""
    blob = bytes(blob)
    cut = 8 + int.from_bytes(blob[:8], "little")
    ends = np.cumsum(unpack(blob[8:cut], "u4"), dtype="i8").tolist()
    data = unpack(blob[cut:], "u1").tobytes()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

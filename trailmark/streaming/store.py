"""Folder in which a stream leaves its results, merged level by level."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trailmark.sources.folders import names, publish, read_text, remove

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Manifests that stay, for readers that have just opened one.
KEPT_MANIFESTS = 3

Merge = Callable[[DataFrame], DataFrame]


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state on executor disk instead of the heap, for states that outgrow it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class LevelledTable:
    """Rows that arrive in batches and merge, such as first and last visits, in few tables.

    A batch is a table of level 0.  Two tables of one level become one of the next, as digits carry in a binary count:
    after n batches there are at most log2(n) + 1 tables, and a row is written again at most that often.  A manifest,
    made only if there is none of its number, names the tables; so readers see all of a batch or nothing, and a batch
    that runs again is found there and changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, merge: Merge):
        self.spark, self.folder, self.schema, self.merge = spark, folder.rstrip("/"), schema, merge

    def _numbers(self) -> list[int]:
        found = [n for n in names(self.spark, f"{self.folder}/manifest") if re.fullmatch(r"\d{12}[.]json", n)]
        return [int(n[:12]) for n in found]

    def _file(self, number: int) -> str:
        return f"{self.folder}/manifest/{number:012d}.json"

    def _manifest(self, number: int | None = None) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "batch": -1, "runs": []}
        return json.loads(read_text(self.spark, self._file(number or numbers[-1])))

    def runs(self) -> list[tuple[int, str]]:
        """(level, table) of the newest manifest, high levels first."""
        return [tuple(r) for r in self._manifest()["runs"]]

    def read(self) -> DataFrame:
        """All rows; none before the first batch.  Rows of different tables still have to be merged."""
        paths = [f"{self.folder}/{name}" for _, name in self.runs()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, level: int) -> tuple[int, str]:
        name = f"level={level}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        return level, name

    def add(self, rows: DataFrame, batch_id: int) -> bool:
        """Add the rows of a batch; whether it was new."""
        now = self._manifest()
        if batch_id <= now["batch"]:
            return False
        runs, level = [tuple(r) for r in now["runs"]], 0
        made = [self._write(rows, 0)]
        while runs and runs[-1][0] == level:
            both = [f"{self.folder}/{name}" for _, name in (runs.pop(), made[-1])]
            level += 1
            made.append(self._write(self.merge(self.spark.read.schema(self.schema).parquet(*both)), level))
        text = json.dumps({"number": now["number"] + 1, "batch": batch_id, "runs": [*runs, made[-1]]})
        if not publish(self.spark, self._file(now["number"] + 1), text):
            raise RuntimeError(f"two streams write to {self.folder}")
        self._forget({name for _, name in made[:-1]})
        return True

    def _forget(self, passed: set[str]) -> None:
        """Remove manifests but the newest few, and tables that no manifest left names."""
        numbers = self._numbers()
        used, gone = set(), set(passed)
        for number in numbers:
            tables = {name for _, name in self._manifest(number)["runs"]}
            if number in numbers[-KEPT_MANIFESTS:]:
                used |= tables
            else:
                gone |= tables
                remove(self.spark, self._file(number))
        for name in gone - used:
            remove(self.spark, f"{self.folder}/{name}")


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """What names a stream over its restarts: the id in its checkpoint, which a new checkpoint has anew."""
    text = read_text(spark, f"{checkpoint.rstrip('/')}/metadata")
    return json.loads(text)["id"] if text else checkpoint


def start(stream: DataFrame, on_batch, checkpoint: str, output_mode: str, **trigger) -> StreamingQuery:
    """Start a stream that hands every batch to ``on_batch``; by default it ends when all input is read."""
    return (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(on_batch)
        .start()
    )

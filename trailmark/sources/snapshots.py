"""Versioned snapshots of the processed state as Parquet tables.

Every table that is written gets a folder of its own that no other write uses.  A version is a small file that names
the folders of each of its tables; it comes last, so a version exists for readers only when all its tables do, and a job
that dies half-way leaves nothing but folders nobody names.  What did not change is named again and not copied: whole
tables, or single buckets of a table that is kept in buckets.

Versions follow each other by number, whoever writes.  A change is built upon the newest version and may only become the
next number: the file of that number is made only if there is none.  Who finds it taken, or finds tables gone that the
change read, starts anew from the version that is the newest then, so of simultaneous changes none is lost.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Collection
from dataclasses import dataclass, field
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trailmark.config import ProgressConfig
from trailmark.operators.schema import ensure_schema
from trailmark.sources.folders import names, publish, read_text, remove

_METADATA = (
    "version string, number bigint, last_sync_at timestamp_ntz, source string, folders map<string,array<string>>, "
    "schemas map<string,string>, rows map<string,bigint>, marks map<string,string>"
)
#: Column that deals a table into buckets, and how often a change is built anew when others come first.
BUCKET, ATTEMPTS = "trailmark_bucket", 10


class Conflict(RuntimeError):
    """Others kept committing while a change was built."""


@dataclass(frozen=True)
class Snapshot:
    """One version: its tables and their folders by name, rows written by it, and when its data was last brought up to date.

    ``marks`` are short notes of writers that every later version keeps, such as the last batch of a stream.
    """

    version: str | None
    last_sync_at: datetime | None
    source: str | None
    tables: dict[str, DataFrame]
    folders: dict[str, list[str]] = field(default_factory=dict)
    number: int = 0
    rows: dict[str, int] = field(default_factory=dict)
    marks: dict[str, str] = field(default_factory=dict)


def bucket_of(folder: str) -> int | None:
    """The bucket a folder holds; None if it holds a whole table."""
    found = re.search(rf"/{BUCKET}=(\d+)$", folder)
    return int(found[1]) if found else None


class Change:
    """A version that is being made from the newest one, ``base``; what is not put or dropped stays as it is there."""

    def __init__(self, store: SnapshotStore, base: Snapshot | None, schemas: dict[str, str]):
        self.store, self.base = store, base
        self.folders = dict(base.folders) if base else {}
        self.schemas = dict(schemas)
        self.marks = dict(base.marks) if base else {}
        self.rows: dict[str, int] = {}
        self.written: list[str] = []

    def put(self, name: str, table: DataFrame, replaced: Collection[int] | None = None) -> DataFrame:
        """Write a table and read it back.

        A table with a column ``BUCKET`` is kept in buckets.  Its rows take the place of what the version has in the
        ``replaced`` buckets, all others stay; by default all are replaced.
        """
        folder = f"{name}/{uuid.uuid4().hex}"
        self.written.append(folder)
        counted = Observation()
        rows = table.observe(counted, F.count(F.lit(1)).alias("rows"))
        if BUCKET in table.columns:
            rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.store.folder}/{folder}")
            made = [f"{folder}/{n}" for n in names(self.store.spark, f"{self.store.folder}/{folder}") if bucket_of(f"/{n}") is not None]
            stay = [] if replaced is None else [f for f in self.folders.get(name, []) if bucket_of(f) not in set(replaced)]
            schema = table.drop(BUCKET).schema
        else:
            rows.write.parquet(f"{self.store.folder}/{folder}")
            made, stay, schema = [folder], [], table.schema
        self.rows[name] = counted.get.get("rows", 0)
        self.folders[name] = sorted(stay + made)
        self.schemas[name] = schema.json()
        return self.store.table(made, self.schemas[name])

    def part(self, name: str, buckets: Collection[int] | None = None) -> DataFrame:
        """Rows of some buckets, or all, of a table of ``base``, each with its bucket."""
        folders = [f for f in self.base.folders[name] if buckets is None or bucket_of(f) in set(buckets)]
        rows = self.store.table(folders, self.schemas[name])
        if not folders:
            return rows.withColumn(BUCKET, F.lit(None).cast("int"))
        found = F.regexp_extract(F.col("_metadata.file_path"), rf"/{BUCKET}=([0-9]+)/[^/]*$", 1)
        return rows.withColumn(BUCKET, found.cast("int"))

    def table(self, name: str) -> DataFrame:
        """A table as the new version has it so far."""
        return self.store.table(self.folders[name], self.schemas[name])

    def in_buckets(self, *tables: str) -> bool:
        """Whether ``base`` has these tables in buckets."""
        here = self.base is not None and all(n in self.base.folders for n in tables)
        return here and all(bucket_of(f) is not None for n in tables for f in self.base.folders[n])

    def drop(self, *tables: str) -> None:
        """Leave tables out of the version."""
        for name in tables:
            self.folders.pop(name, None)
            self.schemas.pop(name, None)

    def keep_only(self, *tables: str) -> None:
        """Leave all other tables out."""
        self.drop(*[n for n in self.folders if n not in tables])


class SnapshotStore:
    """Snapshots below one folder; versions are ordered by their number."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, folders: list[str], schema: str) -> DataFrame:
        """A table by its folders below the store and its schema, as JSON."""
        kind = StructType.fromJson(json.loads(schema))
        paths = [f"{self.folder}/{f}" for f in folders]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def update(
        self,
        version: str,
        build: Callable[[Change], bool | None],
        last_sync_at: datetime | None = None,
        source: str | None = None,
        keep_sync: bool = False,
    ) -> Snapshot | None:
        """Make the next version by ``build`` from the newest; returns it.

        ``build`` runs again from the then newest version if another one came first, so it has to depend on its
        ``Change`` alone; what it wrote before is removed.  Nothing is made if it returns False.  ``keep_sync`` takes
        the time of the last update from the version before.
        """
        for _ in range(ATTEMPTS):
            row = self._newest()
            base = self._snapshot(row) if row else None
            change = Change(self, base, row["schemas"] if row else {})
            try:
                wanted = build(change)
            except (PySparkException, Py4JJavaError):
                if self._number() == (base.number if base else 0):
                    raise
                wanted = None  # others came first and may have expired what this change was reading
            else:
                if wanted is False:
                    self._discard(change)
                    return base
                number = (base.number if base else 0) + 1
                at = base.last_sync_at if keep_sync and base else last_sync_at
                meta = {
                    "version": version,
                    "number": number,
                    "last_sync_at": at.isoformat() if at else None,
                    "source": source if source is not None or base is None else base.source,
                    "folders": change.folders,
                    "schemas": change.schemas,
                    "rows": change.rows,
                    "marks": change.marks,
                }
                if publish(self.spark, self._file(number), json.dumps(meta)):
                    return self._snapshot(meta)
            self._discard(change)
        raise Conflict(f"version {version} was overtaken {ATTEMPTS} times")

    def _discard(self, change: Change) -> None:
        for folder in change.written:
            remove(self.spark, f"{self.folder}/{folder}")

    def write(
        self,
        version: str,
        tables: dict[str, DataFrame],
        last_sync_at: datetime | None = None,
        source: str | None = None,
        unchanged: Collection[str] = (),
    ) -> Snapshot:
        """A version of these tables and of the ``unchanged`` ones of the version before, by name."""

        def build(change: Change) -> None:
            change.keep_only(*unchanged)
            for name, table in tables.items():
                change.put(name, table)

        return self.update(version, build, last_sync_at, source)

    def versions(self) -> DataFrame | None:
        """Metadata of all versions, one row each; None if there are none."""
        return self.spark.read.schema(_METADATA).json(f"{self.folder}/metadata") if self._number() else None

    def _file(self, number: int) -> str:
        return f"{self.folder}/metadata/{number:012d}.json"

    def _number(self) -> int:
        """Number of the newest version, 0 if there is none."""
        found = [n for n in names(self.spark, f"{self.folder}/metadata") if re.fullmatch(r"\d{12}[.]json", n)]
        return int(found[-1][:12]) if found else 0

    def _newest(self, version: str | None = None) -> dict | None:
        if version is None:
            number = self._number()
            text = read_text(self.spark, self._file(number)) if number else None
            return json.loads(text) if text else None
        versions = self.versions()
        row = None if versions is None else versions.where(F.col("version") == version).orderBy(F.desc("number")).first()
        return row.asDict() if row else None

    def _snapshot(self, row: dict) -> Snapshot:
        at = row["last_sync_at"]
        tables = {n: self.table(f, row["schemas"][n]) for n, f in sorted(row["folders"].items())}
        at = datetime.fromisoformat(at) if isinstance(at, str) else at
        return Snapshot(row["version"], at, row["source"], tables, dict(row["folders"]), row["number"], dict(row["rows"]), dict(row["marks"]))

    def read(self, version: str | None = None) -> Snapshot | None:
        """A version, the newest by default; None if it does not exist."""
        row = self._newest(version)
        return self._snapshot(row) if row else None

    def load(self, cfg: ProgressConfig, roster: DataFrame | None = None) -> Snapshot | None:
        """Newest version, made usable.

        Without any version the roster becomes original and processed table.
        An empty processed table is replaced by the original, and the time of
        the last update is then unknown.
        """
        snapshot = self.read()
        if snapshot is None:
            if roster is None:
                return None
            tables = {"original": roster, "processed": ensure_schema(roster, cfg)}
            return Snapshot(None, None, None, tables)
        processed, original = (snapshot.tables.get(n) for n in ("processed", "original"))
        if (processed is None or processed.isEmpty()) and original is not None and not original.isEmpty():
            tables = {**snapshot.tables, "processed": ensure_schema(original, cfg)}
            return Snapshot(snapshot.version, None, snapshot.source, tables, snapshot.folders, snapshot.number)
        return snapshot

    def expire(self, keep: int) -> None:
        """Remove all but the newest ``keep`` versions and the table folders that none of those names.

        The file of a version goes first, so a version whose folders are going is already out of sight.  Folders of
        changes that are still being written have no version yet and stay.
        """
        versions = self.versions()
        rows = [] if versions is None else versions.orderBy(F.desc("number")).select("number", "folders").collect()  # one a version
        used = {f for row in rows[:keep] for own in row.folders.values() for f in own}
        gone = {f for row in rows[keep:] for own in row.folders.values() for f in own} - used
        for row in rows[keep:]:
            remove(self.spark, self._file(row.number))
        for folder in gone:
            remove(self.spark, f"{self.folder}/{folder}")
        for parent in {f.rpartition("/")[0] for f in gone if bucket_of(f) is not None}:
            if not any(f.startswith(f"{parent}/") for f in used):
                remove(self.spark, f"{self.folder}/{parent}")

"""Search by pieces of text without reading all participants.

A posting table has every run of one, two or three characters of id, name and phone with the rows that have it, sorted
by run, so a search reads the postings of its own runs only.  Rows that have all runs of a text are candidates; only
their buckets are opened and only they are compared with the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.sources.snapshots import BUCKET, Change, Snapshot, SnapshotStore, bucket_of

#: Longest run of characters, buckets of the rows, and candidates that are asked for one by one.
RUN, PARTS, FEW = 3, 64, 1000
KEY = "search_key"


def _runs(text: Column, size: int) -> Column:
    """Distinct runs of so many characters."""
    last = F.length(text) - size + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def runs_of(text: str) -> list[str]:
    """The runs a row must have to contain a text: all of the longest size, or the text itself if it is shorter."""
    return sorted({text[i : i + RUN] for i in range(len(text) - RUN + 1)}) if len(text) >= RUN else [text]


def postings(rows: DataFrame) -> DataFrame:
    """(run, part, key) of rows with a key and a part, sorted by run; a run that many rows have is spread over files."""
    texts = [F.coalesce("id", F.lit("")), F.lower(F.coalesce("name", F.lit(""))), F.coalesce("phone", F.lit(""))]
    runs = F.array_distinct(F.flatten(F.array(*[_runs(t, size) for t in texts for size in range(1, RUN + 1)])))
    made = rows.select(F.explode(runs).alias("run"), F.col(BUCKET).alias("part"), KEY)
    return made.repartitionByRange("run", KEY).sortWithinPartitions("run", KEY)


def put_index(change: Change, rows: DataFrame, parts: int = PARTS) -> None:
    """Write display rows in buckets and their postings as tables of a version."""
    part = F.pmod(F.xxhash64("id", "name", "phone"), F.lit(parts)).cast("int")
    change.put("search_rows", rows.withColumns({KEY: F.monotonically_increasing_id(), BUCKET: part}))
    written = change.store.table(change.folders["search_rows"], change.schemas["search_rows"])
    bucket = F.regexp_extract(F.col("_metadata.file_path"), rf"/{BUCKET}=([0-9]+)/[^/]*$", 1).cast("int")
    change.put("postings", postings(written.withColumn(BUCKET, bucket)))


def candidates(posted: DataFrame, text: str) -> DataFrame:
    """(part, key) of rows that have all runs of a text."""
    runs = runs_of(text.lower())
    found = posted.where(F.col("run").isin(*runs)).groupBy("part", KEY).agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(runs)).select("part", KEY)


def candidate_rows(store: SnapshotStore, snapshot: Snapshot, text: str) -> DataFrame:
    """Display rows that may contain a text, read from the buckets that have such rows.

    Up to ``FEW`` candidates are named to the scan; more are joined.
    """
    found = candidates(snapshot.tables["postings"], text)
    first = found.limit(FEW + 1).collect()
    few = len(first) <= FEW
    parts = {r.part for r in first} if few else {r.part for r in found.select("part").distinct().collect()}
    folders = [f for f in snapshot.folders["search_rows"] if bucket_of(f) in parts]
    rows = store.table(folders, snapshot.tables["search_rows"].schema.json())
    if few:
        rows = rows.where(F.col(KEY).isin([r[KEY] for r in first])) if first else rows
    else:
        rows = rows.join(found.select(KEY), KEY, "left_semi")
    return rows.drop(KEY)

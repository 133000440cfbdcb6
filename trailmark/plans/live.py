"""Participants kept up to date by small portions of logs.

Visits, roster and processed participants are kept in buckets of phones, so a portion reads and rewrites only the
buckets of its phones, and of the participants there only those whose summary changed are classified again.  All tables
of a portion become one version of the store, together with the counts, which change by the differences.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.config import DEFAULT_CONFIG, ProgressConfig
from trailmark.functions.text import with_phone_key
from trailmark.operators import tallies
from trailmark.operators.logs import VISITS, merge_visits, screen_visits, summarise
from trailmark.plans.refresh import refresh_participants
from trailmark.sources.folders import remove
from trailmark.sources.snapshots import BUCKET, Change, Snapshot, SnapshotStore
from trailmark.sources.workdir import new_folder, stored

#: Participants of a bucket of a new store, and its least and greatest number of buckets; a store keeps the number it began with.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 50_000, 16, 4096
#: All participants are classified anew when their statuses are older than this.
OUTDATED = timedelta(days=1)
_BUCKETS, _CLASSIFIED = "buckets", "classified at"


def _dealt(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def in_buckets(participants: DataFrame, n: int) -> DataFrame:
    """Participants dealt by phone; those without a whole phone never meet a log and are spread by their content."""
    keyed = with_phone_key(participants, "phone", "_key")
    spread = F.pmod(F.xxhash64(*participants.columns), F.lit(n)).cast("int")
    return keyed.withColumn(BUCKET, F.when(F.col("_key") != "", _dealt(F.col("_key"), n)).otherwise(spread)).drop("_key")


def _same(row: str, other: str, columns: list[str]) -> Column:
    hit = F.lit(True)
    for c in columns:
        hit = hit & F.col(f"{row}.{c}").eqNullSafe(F.col(f"{other}.{c}"))
    return hit


def _changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Summary rows that are new or not what they were."""
    rest = [c for c in after.columns if c != "phone_key"]
    same = (F.col("a.phone_key") == F.col("b.phone_key")) & _same("a", "b", rest)
    return after.alias("a").join(before.alias("b"), same, "left_anti")


def _some(
    change: Change, fresh: DataFrame, visits: DataFrame, before: DataFrame, touched: list[int], now: datetime, cfg: ProgressConfig, scratch: str
) -> None:
    """Classify the participants whose summary the fresh visits changed; all other rows of their buckets are copied."""
    phones = fresh.select("phone_key").distinct()
    old, new = (summarise(v.join(phones, "phone_key", "left_semi"), cfg) for v in (before, visits))
    changed = stored(_changed(old, new), "changed", scratch)

    def of_changed(rows: DataFrame, how: str) -> DataFrame:
        return with_phone_key(rows, "phone", "phone_key").join(changed.select("phone_key"), "phone_key", how).drop("phone_key")

    again = stored(refresh_participants(of_changed(change.part("roster", touched), "left_semi"), changed, now, cfg), "classified", scratch)
    buckets = [r[0] for r in again.select(BUCKET).distinct().collect()]  # no more than there are
    if not buckets:
        return
    held = change.part("processed", buckets)
    if "tallies" in change.folders:
        moved = tallies.difference(of_changed(held, "left_semi"), again, cfg)
        change.put("tallies", tallies.merged(change.base.tables["tallies"].unionByName(moved)))
    change.put("processed", of_changed(held, "left_anti").unionByName(again), buckets)
    change.drop("postings", "search_rows")


def fold_logs(
    store: SnapshotStore,
    logs: DataFrame,
    now: datetime,
    version: str,
    cfg: ProgressConfig = DEFAULT_CONFIG,
    participants: DataFrame | None = None,
    buckets: int | None = None,
    mark: tuple[str, int] | None = None,
) -> Snapshot | None:
    """Add a portion of logs to the newest version of a store and write the next one.

    A store without versions starts from ``participants``.  Every participant the portion touches is as a refresh with
    all logs so far would leave it at ``now``; so are all others at the time they were last classified, which is at most
    a day ago, or at ``now`` after the first portion, an upload or a refresh by others.  ``buckets`` is their number in a
    store that has none yet; by default it grows with the participants.  ``mark`` names the portion: a portion whose
    number is not above that of its last one is in the store already and changes nothing.
    """
    def known(marks: dict[str, str]) -> bool:
        return mark is not None and int(marks.get(mark[0], -1)) >= mark[1]

    newest = store.read()
    if newest and known(newest.marks):
        return newest
    scratch = new_folder(store.spark, "portion")
    fresh = stored(screen_visits(logs, cfg), "visits", scratch)

    def build(change: Change) -> bool | None:
        base = change.base
        if known(change.marks):
            return False
        if mark:
            change.marks[mark[0]] = str(mark[1])
        if base is None and participants is None:
            raise ValueError("the store is empty: give the participants to start from")
        source = participants if base is None else base.tables["processed"]
        if _BUCKETS not in change.marks:
            change.marks[_BUCKETS] = str(buckets or min(MOST_BUCKETS, max(LEAST_BUCKETS, source.count() // BUCKET_ROWS)))
        n = int(change.marks[_BUCKETS])
        dealt = fresh.withColumn(BUCKET, _dealt(F.col("phone_key"), n))
        touched = [r[0] for r in dealt.select(BUCKET).distinct().collect()]  # no more than there are buckets
        had = change.part("visits", touched).drop(BUCKET) if "visits" in change.folders else None
        before = store.spark.createDataFrame([], VISITS) if had is None else had
        visits = before
        if touched or "visits" not in change.folders:
            together = merge_visits(before.unionByName(fresh))
            visits = change.put("visits", together.withColumn(BUCKET, _dealt(F.col("phone_key"), n)), touched)
        started = change.in_buckets("roster", "processed")
        current = started and now - datetime.fromisoformat(change.marks[_CLASSIFIED]) < OUTDATED
        if current:
            _some(change, fresh, visits, before, touched, now, cfg, scratch)
            return None
        if not started:
            if base is None:
                change.put("original", participants)
            change.put("roster", in_buckets(source, n))
        summary = summarise(change.table("visits"), cfg)
        processed = change.put("processed", refresh_participants(in_buckets(change.table("roster"), n), summary, now, cfg))
        change.marks[_CLASSIFIED] = now.isoformat()
        change.put("tallies", tallies.tally(processed, cfg))
        change.drop("postings", "search_rows")
        return None

    try:
        made = store.update(version, build, now)
    finally:
        remove(store.spark, scratch)
    store.expire(cfg.retained_versions)
    return made

"""Streams and portions of logs end up with the rows of the batch run, also after a restart."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trailmark.config import DEFAULT_CONFIG as CFG
from trailmark.operators import dashboard, tallies
from trailmark.operators.comments import latest_comments
from trailmark.operators.logs import VISITS, log_summary, merge_visits, screen_visits, summarise
from trailmark.plans.dashboard import dashboard_tables
from trailmark.plans.live import fold_logs
from trailmark.plans.refresh import refresh_participants
from trailmark.plans.tracker import Tracker
from trailmark.sources.snapshots import Change, SnapshotStore
from trailmark.streaming.comments import COMMENTS, stream_comments
from trailmark.streaming.logs import stream_visits, streamed_summary
from trailmark.streaming.refresh import stream_refresh
from trailmark.streaming.store import LevelledTable

AS_OF = datetime(2024, 1, 31)
SCHEMA = "phone string, entered_at string, screen string, entry string"
SCREENS = ["L1B1S0_15", "L1B2S1_3", "L2B3S4_15", "X9Z9", None]


def logs(spark, first, count):
    """Rows in falling order of time, so that every later file has the earlier rows."""
    start = datetime(2024, 1, 20)
    rows = [
        (f"9{i % 5:08d}", (start - timedelta(hours=i)).strftime("%Y-%m-%d %H:%M:%S"), SCREENS[i % 5 - i % 3], None)
        for i in range(first, first + count)
    ]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def text(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


def source(spark, path, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_summary_of_a_stream_that_is_restarted(spark, folder):
    for first in (0, 20, 40):
        logs(spark, first, 20).write.mode("append").parquet(folder("in"))

    def go():
        stream_visits(source(spark, folder("in")), folder("out"), folder("state"), CFG).awaitTermination()

    go()
    assert text(streamed_summary(spark, folder("out"), CFG)) == text(log_summary(logs(spark, 0, 60), CFG))
    logs(spark, 60, 30).write.mode("append").parquet(folder("in"))
    go()
    expected = text(log_summary(logs(spark, 0, 90), CFG))
    assert text(streamed_summary(spark, folder("out"), CFG)) == expected


def test_few_tables_after_many_batches(spark, folder):
    table = LevelledTable(spark, folder("t"), "k string, n bigint", lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")))
    assert table.read().count() == 0
    for i in range(64):
        new = spark.createDataFrame([(str(i % 5), 1), ("all", 1)], "k string, n bigint").coalesce(1)
        assert table.add(new, i)
        assert len(table.runs()) == bin(i + 1).count("1") <= 7
        if i in (20, 41):
            assert not table.add(new, i)  # a batch that runs again
    got = {r.k: r.n for r in table.read().groupBy("k").agg(F.sum("n").alias("n")).collect()}
    assert got == {"all": 64, "0": 13, "1": 13, "2": 13, "3": 13, "4": 12}


def test_merged_levels_leave_nothing_behind(spark, tmp_path, folder):
    table = LevelledTable(spark, folder("v"), VISITS, merge_visits)
    for i in range(9):
        table.add(screen_visits(logs(spark, 10 * i, 10), CFG), i)
    assert text(summarise(merge_visits(table.read()), CFG)) == text(log_summary(logs(spark, 0, 90), CFG))
    assert len(list((tmp_path / "v" / "manifest").glob("0*"))) == 3
    assert len(list((tmp_path / "v").glob("level=*/*"))) <= 6


PEOPLE = "row_no bigint, id string, phone string, state string, completed string, school string, enrolled_at string"


def people(spark, count=8):
    rows = [
        (i, str(i), f"9{i:08d}" if i % 7 != 6 else None, "falso" if i == 3 else None, "True" if i == 7 else None, "AB"[i % 2], "2024-01-0%d" % (1 + i % 9))
        for i in range(count)
    ]
    return spark.createDataFrame(rows, PEOPLE)


def refreshed(spark, roster, *log_ranges, now=AS_OF):
    seen = [logs(spark, first, count) for first, count in log_ranges]
    every = seen[0]
    for more in seen[1:]:
        every = every.unionByName(more)
    return refresh_participants(roster, log_summary(every, CFG), now, CFG)


def test_refresh_stream(spark, folder):
    for first in (0, 20):
        logs(spark, first, 20).write.mode("append").parquet(folder("in"))
    store = SnapshotStore(spark, folder("snapshots"))
    stream_refresh(source(spark, folder("in")), people(spark), store, folder("state"), lambda: AS_OF, CFG).awaitTermination()
    assert text(store.load(CFG).tables["processed"]) == text(refreshed(spark, people(spark), (0, 40)))
    rows = store.versions().orderBy("number").collect()
    assert [r.version for r in rows] == ["batch 0", "batch 1"] and rows[0].folders["original"] == rows[1].folders["original"]
    before = store.read()
    stream_refresh(source(spark, folder("in")), people(spark), store, folder("state"), lambda: AS_OF, CFG).awaitTermination()
    assert store.read().number == before.number  # nothing new came


def test_a_batch_that_runs_again_changes_nothing(spark, folder):
    store = SnapshotStore(spark, folder("s"))
    for i in (0, 0, 1, 0, 1):
        made = fold_logs(store, logs(spark, 20 * i, 20), AS_OF, f"batch {i}", CFG, people(spark), mark=("stream", i))
    assert made.number == 2 and text(made.tables["processed"]) == text(refreshed(spark, people(spark), (0, 40)))


def test_a_portion_of_one_phone_writes_one_bucket(spark, tmp_path, folder, monkeypatch):
    store, roster = SnapshotStore(spark, folder("s")), people(spark, 60)
    fold_logs(store, logs(spark, 0, 20), AS_OF, "1", CFG, roster)
    tables = ("visits", "roster", "processed")
    had = {t: set((tmp_path / "s" / t).glob("*/*=*")) for t in tables}
    read = []
    monkeypatch.setattr(Change, "part", lambda self, name, buckets=None, f=Change.part: read.append((name, buckets)) or f(self, name, buckets))
    one = logs(spark, 20, 20).where("phone = '900000004'").withColumn("screen", F.lit("L2B3S1_33"))
    made = fold_logs(store, one, AS_OF, "2", CFG)
    new = {t: {p for p in (tmp_path / "s" / t).glob("*/*=*")} - had[t] for t in tables}
    assert [len(new[t]) for t in tables] == [1, 0, 1]
    assert len({p.name for t in tables for p in new[t]}) == 1  # the same bucket
    assert {n for n, b in read} == set(tables) and all(len(b) == 1 for _, b in read)  # no other participants are scanned
    assert made.rows["processed"] < 10
    every = logs(spark, 0, 20).unionByName(one)
    assert text(made.tables["processed"]) == text(refresh_participants(roster, log_summary(every, CFG), AS_OF, CFG))
    # rows that change no summary leave the participants alone
    again = fold_logs(store, one, AS_OF, "3", CFG)
    assert again.folders["processed"] == made.folders["processed"] and again.number == made.number + 1


def counts(tables):
    return {n: text(tables[n]) for n in ("kpis", "funnel", "sections", "schools", "cohorts", "cohort_status", "call_list_counts", "filter_values")}


def test_counts_by_differences_equal_a_recount(spark, folder):
    store = SnapshotStore(spark, folder("s"))
    for i in range(3):
        made = fold_logs(store, logs(spark, 12 * i, 12), AS_OF, str(i), CFG, people(spark, 40))
        plain = dashboard_tables(made.tables["processed"], AS_OF, CFG)
        kept = dashboard_tables(made.tables["processed"], AS_OF, CFG, kept=made.tables["tallies"])
        assert counts(kept) == counts(plain)
    assert made.tables["tallies"].where("n < 0").count() == 0
    late = AS_OF + timedelta(days=9)
    assert text(tallies.cohort_counts(made.tables["tallies"], late, CFG)) == text(dashboard.cohort_counts(made.tables["processed"], late, CFG))


def test_all_are_classified_again_after_a_day(spark, folder):
    store, clock = SnapshotStore(spark, folder("s")), AS_OF
    for i, step in enumerate((timedelta(0), timedelta(hours=2), timedelta(days=3))):
        clock += step
        made = fold_logs(store, logs(spark, 20 * i, 20), clock, str(i), CFG, people(spark, 30))
    assert text(made.tables["processed"]) == text(refreshed(spark, people(spark, 30), (0, 60), now=clock))
    plain = dashboard_tables(made.tables["processed"], clock, CFG)
    assert counts(dashboard_tables(made.tables["processed"], clock, CFG, kept=made.tables["tallies"])) == counts(plain)


def test_streams_expire_their_versions(spark, tmp_path, folder):
    store = SnapshotStore(spark, folder("s"))
    for i in range(7):
        fold_logs(store, logs(spark, 5 * i, 5), AS_OF, str(i), CFG, people(spark, 20), buckets=4)
    kept = store.versions().collect()
    assert sorted(r.version for r in kept) == ["4", "5", "6"]
    named = {f"{tmp_path}/s/{f}" for r in kept for own in r.folders.values() for f in own}
    held = {str(p) for p in (tmp_path / "s").glob("*/*/*=*")} | {str(p) for t in ("original", "tallies") for p in (tmp_path / "s" / t).iterdir()}
    assert held == named
    assert all(any(f.startswith(str(p)) for f in named) for t in ("visits", "processed", "roster") for p in (tmp_path / "s" / t).iterdir())


def test_uploads_and_comments_between_batches(spark, folder):
    store = SnapshotStore(spark, folder("s"))
    tracker = Tracker(store)
    first, second = people(spark), people(spark, 14)
    fold_logs(store, logs(spark, 0, 20), AS_OF, "0", CFG, first, mark=("s", 0))
    # an upload, as a tracker does it, and two more commits
    def upload(change):
        change.keep_only("visits")
        change.put("original", second)
        change.put("processed", second)

    store.update("upload", upload)
    notes = spark.createDataFrame([("2", "llamar", AS_OF), ("77", "?", AS_OF)], COMMENTS)
    for _ in range(2):
        tracker.comment(notes, AS_OF)
    made = fold_logs(store, logs(spark, 20, 20), AS_OF, "1", CFG, first, mark=("s", 1))
    expected = refreshed(spark, second, (0, 40)).withColumn("comments", F.expr("if(id = '2', 'llamar', null)"))
    assert text(made.tables["processed"]) == text(expected)
    # a comment on participants in buckets rewrites theirs and outlives the next portion
    tracker.comment(notes.withColumn("comment", F.lit("otra vez")), AS_OF)
    made = fold_logs(store, logs(spark, 40, 20), AS_OF, "2", CFG, first, mark=("s", 2))
    assert {r.id: r.comments for r in made.tables["processed"].where("comments is not null").collect()} == {"2": "otra vez"}
    assert [r.match_id for r in made.tables["unmatched"].collect()] == ["77"]
    # a whole refresh by the tracker goes on from there, and a portion goes on from it
    report = logs(spark, 0, 60).withColumnsRenamed({"phone": "Numero Telefono", "entered_at": "HoradeEntradaPantalla", "screen": "IDPantalla", "entry": "Registro"})
    tracker.sync(report, AS_OF)
    made = tracker.add_logs(report, AS_OF)
    expected = refreshed(spark, second, (0, 60)).withColumn("comments", F.expr("if(id = '2', 'otra vez', null)"))
    assert text(made.tables["processed"]) == text(expected)


def test_streams_without_input(spark, folder):
    logs(spark, 0, 0).write.parquet(folder("in"))
    stream_visits(source(spark, folder("in")), folder("out"), folder("state"), CFG).awaitTermination()
    assert streamed_summary(spark, folder("nowhere"), CFG).count() == 0
    assert streamed_summary(spark, folder("out"), CFG).count() == 0


def test_comment_stream(spark, folder):
    store = SnapshotStore(spark, folder("s"))
    tracker = Tracker(store)
    t = [datetime(2024, 1, d) for d in (1, 2, 3)]
    late = spark.createDataFrame([("1", "c", t[2]), ("2", "a", t[0]), ("99", "?", t[0])], COMMENTS)
    early = spark.createDataFrame([("1.0", "b", t[1]), ("2", "b", t[1]), ("98", "!", t[0])], COMMENTS)
    for df in (late, early):
        df.coalesce(1).write.mode("append").parquet(folder("in"))
    fold_logs(store, logs(spark, 0, 20), AS_OF, "0", CFG, people(spark))

    def go(state):
        stream_comments(source(spark, folder("in"), COMMENTS), store, folder(state), CFG).awaitTermination()
        return store.read()

    made = go("state")
    expected = {r.match_id: r.comment for r in latest_comments(late.unionByName(early)).collect()}
    assert {r.id: r.comments for r in tracker.dashboard(AS_OF)["records"].where("comments is not null").collect()} == {"1": "c", "2": "b"}
    assert sorted(r.match_id for r in made.tables["unmatched"].collect()) == ["98", "99"] and expected["1"] == "c"
    assert made.last_sync_at == AS_OF
    assert go("state").number == made.number  # a restart finds its batches in the store
    again = go("another")  # the same comments by another stream change no row
    assert text(again.tables["processed"]) == text(made.tables["processed"])
    assert text(again.tables["unmatched"]) == text(made.tables["unmatched"])


def test_a_comment_stream_needs_participants(spark, folder):
    spark.createDataFrame([("1", "x", AS_OF)], COMMENTS).write.parquet(folder("in"))
    query = stream_comments(source(spark, folder("in"), COMMENTS), SnapshotStore(spark, folder("s")), folder("state"), CFG)
    with pytest.raises(Exception, match="upload a roster first"):
        query.awaitTermination()

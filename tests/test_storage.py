"""Sheets, log scans, snapshots, keyed tables, encryption, comments, export, tracker."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from trailmark.config import DEFAULT_CONFIG as CFG
from trailmark.functions import cells
from trailmark.operators import searching
from trailmark.operators.comments import apply_comments, unmatched_comments
from trailmark.operators.export import export_diff, export_rows, write_export
from trailmark.operators.order import numbered
from trailmark.operators.schema import processed_types
from trailmark.plans.tracker import Tracker
from trailmark.sources import keyed, secure, sheets
from trailmark.sources.folders import names, publish, read_text
from trailmark.sources.log_scan import scan_logs
from trailmark.sources.snapshots import SnapshotStore
from trailmark.sources.workdir import new_folder, shared_folder

KEY = "MDEyMzQ1Njc4OTAxMjM0NTY3ODkwMTIzNDU2Nzg5MDE="
OTHER = "YWJjZGVmZ2hpamFiY2RlZmdoaWphYmNkZWZnaGlqYWI="


def sheet(spark, *rows):
    width = max(map(len, rows))
    data = [(i, *r, *[None] * (width - len(r))) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(data, "row_no bigint, " + ", ".join(f"c{i} string" for i in range(width)))


def roster_sheet(spark):
    return sheet(
        spark, ("Informe",), (None,), ("ID", "Colegio", "Teléfono", "Estado", " ", "Colegio"),
        ("1", "A", "911111111", None, "x", "y"), (None, "sin id"), ("2.0", "B", "922222222", "Notificado"),
    )


def contact_sheet(spark):
    head = [("Contactos",)] * 13 + [tuple(f"h{i}" for i in range(25))]
    rows = [
        tuple({0: i, 1: "A", 2: "Ana", 5: "Leo", 10: "9", 24: "Participante"}.get(p) for p in range(25)) for i in ("2", "3")
    ]
    return sheet(spark, *head, *rows)


def test_roster_and_contacts(spark):
    roster = sheets.read_roster(roster_sheet(spark))
    assert roster.columns == ["row_no", "id", "school", "phone", "state", "column_4", "column_5"]
    assert [(r.row_no, r.id) for r in roster.orderBy("row_no").collect()] == [(4, "1"), (6, "2.0")]
    contacts = sheets.read_contacts(contact_sheet(spark))
    assert [r.id for r in contacts.orderBy("row_no").collect()] == ["2", "3"]
    assert contacts.first().contact_state == "Participante"


def test_bad_sheets_are_named(spark):
    with pytest.raises(ValueError, match="no row 3"):
        sheets.read_roster(sheet(spark, ("only",)))
    with pytest.raises(ValueError, match="25 are needed"):
        sheets.read_contacts(sheet(spark, *[("a", "b")] * 15))
    with pytest.raises(ValueError, match="missing tables: nowhere"):
        sheets.require_tables(spark, ["nowhere"])
    with pytest.raises(ValueError, match="missing columns: screen"):
        sheets.read_logs(spark.createDataFrame([("9", "t")], "`Numero Telefono` string, HoradeEntradaPantalla string"))


def test_log_scan_bounds(spark):
    times = ["2024-01-09 23:59:59", "2024-01-10 00:00:00", "2024-01-21 23:59:59", "2024-01-22 00:00:00", None]
    text = spark.createDataFrame([(t,) for t in times], "entered_at string")
    typed = text.select(F.col("entered_at").cast("timestamp_ntz").alias("at"), F.to_date("entered_at").alias("day"))
    bounds = (date(2024, 1, 10), datetime(2024, 1, 21, 15), CFG)
    assert [r[0] for r in scan_logs(text, *bounds).collect()] == times[1:3]
    assert scan_logs(typed, *bounds, time_column="at", date_column="day").count() == 2


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    assert store.read() is None and store.load(CFG) is None
    people = spark.createDataFrame([("1", "9")], "id string, phone string")
    assert store.load(CFG, people).tables["processed"].first().status == "Desconocido"
    store.write("1", {"processed": people, "original": people}, datetime(2024, 1, 1), "roster.csv")
    store.write("2", {"processed": people.where("false"), "original": people}, datetime(2024, 1, 2))
    assert store.read("1").tables["processed"].count() == 1 and store.read("1").source == "roster.csv"
    recovered = store.load(CFG)
    assert (recovered.version, recovered.last_sync_at) == ("2", None)
    assert recovered.tables["processed"].first().id == "1"
    store.write("2", {"processed": people, "original": people}, datetime(2024, 1, 3))
    assert store.load(CFG).last_sync_at == datetime(2024, 1, 3)


def test_a_version_name_that_comes_twice_loses_nothing(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    people = spark.createDataFrame([("1",)], "id string")
    store.write("now", {"processed": people, "contacts": people})
    old = store.read()
    # what is written reads from the version of the same name
    store.write("now", {"processed": old.tables["processed"].unionByName(people)}, unchanged=["contacts"])
    new = store.read("now")
    assert (new.tables["processed"].count(), new.tables["contacts"].count(), old.tables["processed"].count()) == (2, 1, 1)
    assert store.versions().count() == 2


def test_the_newest_write_counts_whoever_writes(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    for i, name in enumerate(("20240131T000000", "batch 7", "batch 0")):  # a tracker, a stream, a new checkpoint
        store.write(name, {"processed": spark.createDataFrame([(str(i),)], "id string")})
        assert store.read().tables["processed"].first().id == str(i)


def test_expiry_keeps_what_is_still_named(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    people = spark.createDataFrame([("1",)], "id string")
    store.write("1", {"processed": people, "original": people})
    for i in "2345":
        store.write(i, {"processed": people}, unchanged=["original"])
    store.expire(3)
    assert sorted(r.version for r in store.versions().collect()) == ["3", "4", "5"]
    assert store.read("1") is None and store.read().tables["original"].count() == 1
    assert len(list((tmp_path / "processed").iterdir())) == 3 and len(list((tmp_path / "original").iterdir())) == 1


def test_a_snapshot_without_metadata_does_not_exist(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    people = spark.createDataFrame([("1",)], "id string")
    store.write("1", {"processed": people})
    people.write.parquet(str(tmp_path / "processed" / "half"))
    assert store.read().version == "1" and store.read("2") is None


def test_upsert_and_retention(spark):
    t = [datetime(2024, 1, d) for d in (1, 2, 3)]
    schema = "key string, content string, updated_at timestamp_ntz"
    old = spark.createDataFrame([("a", "old", t[1]), ("b", "old", t[2]), ("c", "old", t[0])], schema)
    new = spark.createDataFrame([("a", "new", t[1]), ("b", "new", t[0]), ("d", "new", t[0])], schema)
    got = {r.key: r.content for r in keyed.upsert_latest(old, new).collect()}
    assert got == {"a": "new", "b": "old", "c": "old", "d": "new"}
    many = new.unionByName(old).unionByName(spark.createDataFrame([(None, "x", t[0]), (None, "y", t[0]), ("e", "z", None)], schema))
    kept = keyed.latest(many)
    assert {(r.key, r.content) for r in kept.collect()} == {("a", "old"), ("b", "old"), ("c", "old"), ("d", "new"), (None, "y"), ("e", "z")}
    again = spark.createDataFrame([(None, "w", t[0]), ("e", "older", t[0]), ("a", "gone", t[0])], schema)
    got = {(r.key, r.content) for r in keyed.upsert_latest(kept, again).collect()}
    assert got == {("a", "old"), ("b", "old"), ("c", "old"), ("d", "new"), (None, "w"), ("e", "older")}
    assert keyed.upsert_latest(kept.where("false"), new).count() == 3 and keyed.upsert_latest(kept, new.where("false")).count() == 6
    versions = spark.createDataFrame([(v, i) for i, v in enumerate("abcddb")], "version string, i int")
    assert sorted(r.i for r in keyed.retain_versions(versions, "version", 2).collect()) == [2, 3, 4]


def test_encryption(spark):
    df = spark.createDataFrame([("abcd",), ("ñandú",), (None,)], "phone string")
    sealed = secure.encrypt_columns(df, ["phone"], KEY).persist()
    sizes = [r[0] for r in sealed.select(F.octet_length("phone")).collect()]
    assert sizes == [32, 35, None]
    assert [r[0] for r in secure.decrypt_columns(sealed, ["phone"], KEY).collect()] == ["abcd", "ñandú", None]
    assert [r[0] for r in secure.decrypt_columns(sealed, ["phone"], OTHER).collect()] == [None] * 3
    assert secure.decryption_failures(sealed, ["phone"], OTHER).first().phone == 2
    assert secure.decryption_failures(sealed, ["phone"], KEY).first().phone == 0


def test_plans_do_not_show_the_key(spark, capsys):
    df = spark.createDataFrame([("abcd",)], "phone string")
    secure.decrypt_columns(secure.encrypt_columns(df, ["phone"], KEY), ["phone"], KEY).explain("extended")
    shown = capsys.readouterr().out
    assert "aes_encrypt" in shown and KEY not in shown and "0123456789" not in shown


def test_comments(spark):
    people = spark.createDataFrame(
        [(1, "7.0", "old"), (2, "7", "old"), (3, "8", "old"), (4, None, "old")], "row_no bigint, id string, comments string"
    )
    t = [datetime(2024, 1, d) for d in (1, 2)]
    comments = spark.createDataFrame(
        [("7", "first", t[0]), (" 7.0", "last", t[1]), ("9", "lost", t[0])], "id string, comment string, updated_at timestamp_ntz"
    )
    rows = {r.row_no: r.comments for r in apply_comments(people, comments).collect()}
    assert rows == {1: "last", 2: "old", 3: "old", 4: "old"}
    assert [r.comment for r in unmatched_comments(people, comments).collect()] == ["lost"]


def test_export(spark):
    people = spark.createDataFrame(
        [
            (1, "1.0", "A", "05-12-2023", None, "12.5", "1. x"),
            (2, "2", "B", "pendiente", "True", "nan", "2. y"),
            (3, "9", "C", None, None, None, None),
        ],
        "row_no bigint, id string, school string, first_log_at string, completed string, progress_pct string, status_ordered string",
    )
    processed = processed_types(people, CFG)
    rows = {r.row_no: r for r in export_rows(processed).collect()}
    assert "status_ordered" not in export_rows(processed).columns
    assert (rows[1].first_log_at, rows[1].completed, rows[1].progress_pct, rows[1].status) == ("2023-12-05", False, 12.5, "1. x")
    assert (rows[2].first_log_at, rows[2].funnel_stage) == ("pendiente", "2. y")
    original = spark.createDataFrame(
        [
            (1, "1", "OLD", "2023-12-05 00:00:00", None, "12.50"),
            (2, "2", "B", "pendiente", "1", None),
            (9, "1", "A", "05/12/2023", "nan", "12.50"),
            (10, "4", "D", None, None, None),
        ],
        "row_no bigint, id string, school string, first_log_at string, completed string, progress_pct string",
    )
    diff = {r.row_no: (r.change_kind, r.changed_columns) for r in export_diff(processed, original, CFG).collect()}
    assert diff == {1: ("same", []), 2: ("same", []), 3: ("new", [])}
    changed = export_diff(processed, original.where("row_no < 9"), CFG).where("row_no = 1").first()
    assert (changed.change_kind, changed.changed_columns) == ("changed", ["school"])
    assert {r.change_kind for r in export_diff(processed, None, CFG).collect()} == {"new"}


def test_shared_folder_is_the_one_of_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_tracker(spark, tmp_path):
    tracker = Tracker(SnapshotStore(spark, str(tmp_path)))
    with pytest.raises(ValueError, match="upload"):
        tracker.current()
    tracker.upload(roster_sheet(spark), contact_sheet(spark), datetime(2024, 1, 1), "roster.csv")
    assert tracker.current().last_sync_at is None
    report = spark.createDataFrame(
        [("911111111", "2024-01-20 10:00:00", "L2B3S4_15", "Uso")],
        "`Numero Telefono` string, HoradeEntradaPantalla string, IDPantalla string, Registro string",
    )
    now = datetime(2024, 1, 31)
    synced = tracker.sync(report, now)
    assert (synced.last_sync_at, synced.source) == (now, "roster.csv")
    assert [r.id for r in synced.tables["pending"].collect()] == ["3"]
    assert tracker.dashboard(now)["kpis"].first().asDict() == {"total": 2, "completed": 1, "active": 0, "late": 0}
    notes = spark.createDataFrame(
        [("2", "llamar", now), ("77", "?", now)], "id string, comment string, updated_at timestamp_ntz"
    )
    board = tracker.dashboard(now)
    assert board["last_sync"].first().last_sync_at == now and [r.id for r in board["pending"].collect()] == ["3"]
    assert [r.id for r in tracker.search(now, "2").collect()] == ["2"] and tracker.card(now, "1").count() == 1
    assert tracker.cohort_members(now, 0).count() == 0
    before = len(list(tmp_path.glob("*/*")))
    assert [r.match_id for r in tracker.comment(notes, now).collect()] == ["77"]
    assert len(list(tmp_path.glob("*/*"))) == before + 3  # the participants, the unmatched ids and the metadata
    rows = {r.id: r for r in tracker.export().collect()}
    assert (rows["2.0"].comments, rows["1"].change_kind) == ("llamar", "same")
    assert rows["2.0"].change_kind == "same"
    assert tracker.kept_versions().count() == 3
    folder = tracker.write_export(str(tmp_path / "out"), date(2024, 2, 1))
    assert folder.endswith("/2024-02-01")
    flat = spark.read.csv(f"{folder}/csv", header=True)
    assert flat.count() == 2 and set(flat.columns) >= {"change_kind", "changed_columns"}
    assert text(spark.read.parquet(f"{folder}/parquet")) == text(tracker.export())
    tracker.sync(report, now, date(2024, 1, 21))
    assert tracker.current().tables["processed"].where("first_log_text is not null").count() == 1
    assert tracker.kept_versions().count() == 3


def text(df):
    return sorted(map(str, df.collect()))


def test_recovery_is_stored(spark, tmp_path):
    tracker = Tracker(SnapshotStore(spark, str(tmp_path)))
    people = spark.createDataFrame([("1", "9")], "id string, phone string")
    assert tracker.current(people).tables["processed"].first().status == "Desconocido"
    assert tracker.store.versions().count() == 1
    tracker.store.write("x", {"processed": people.where("false")}, datetime(2024, 1, 2), unchanged=["original"])
    assert tracker.current().last_sync_at is None and tracker.store.read().tables["processed"].count() == 1
    assert tracker.store.versions().count() == 3


def test_a_number_is_given_once(spark, tmp_path):
    file = f"{tmp_path}/m/1.json"
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda i: publish(spark, file, f"writer {i}"), range(8)))
    assert made.count(True) == 1 and read_text(spark, file) == f"writer {made.index(True)}"
    assert names(spark, f"{tmp_path}/m") == ["1.json"] and read_text(spark, f"{tmp_path}/m/2.json") is None


def test_versions_where_files_are_renamed(spark, tmp_path):
    """A file system that is reached by Hadoop alone, as one of a cluster is."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.test.link./in", f"file://{tmp_path}")
    store = SnapshotStore(spark, "viewfs://test/in/store")
    assert publish(spark, "viewfs://test/in/m/1", "a") and not publish(spark, "viewfs://test/in/m/1", "b")
    assert read_text(spark, "viewfs://test/in/m/1") == "a" and names(spark, "viewfs://test/in/m") == ["1"]
    store.write("1", {"t": spark.range(3)})
    store.update("2", lambda change: change.put("t", change.table("t").where("id > 0")) and None)
    store.expire(1)
    assert store.versions().count() == 1 and store.read().tables["t"].count() == 2


def test_a_change_that_was_overtaken_is_built_again(spark, tmp_path):
    store, seen = SnapshotStore(spark, str(tmp_path)), []
    store.write("0", {"t": spark.createDataFrame([(0,)], "i int")})

    def slow(change):
        seen.append(change.base.number)
        if len(seen) < 3:
            for name in "ab" * len(seen):  # others commit and remove what this change was built upon
                store.update(name, lambda c: c.put("t", c.table("t").unionByName(spark.createDataFrame([(9,)], "i int"))) and None)
            store.expire(1)
        change.put("t", change.table("t").unionByName(spark.createDataFrame([(1,)], "i int")))

    made = store.update("slow", slow)
    assert seen == [1, 3, 7] and made.number == 8
    assert sorted(r.i for r in store.read().tables["t"].collect()) == [0, 1, 9, 9, 9, 9, 9, 9]
    store.expire(1)
    assert len(list((tmp_path / "t").iterdir())) == 1  # nothing is left of the attempts


def test_simultaneous_writers_lose_nothing(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    store.write("0", {"t": spark.createDataFrame([], "i int")})

    def add(i):
        return store.update(str(i), lambda c: c.put("t", c.table("t").unionByName(spark.createDataFrame([(i,)], "i int"))) and None).number

    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(add, range(6))) == [2, 3, 4, 5, 6, 7]
    assert sorted(r.i for r in store.read().tables["t"].collect()) == list(range(6))


def test_a_change_may_come_to_nothing(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    people = spark.createDataFrame([("1",)], "id string")
    made = store.write("1", {"processed": people, "none": people.where("false")})
    assert made.rows == {"processed": 1, "none": 0} and made.tables["none"].count() == 0
    assert store.update("2", lambda change: change.put("processed", people) is None).number == 1
    assert store.versions().count() == 1 and len(list((tmp_path / "processed").iterdir())) == 1


def test_a_comment_and_a_refresh_at_once_both_survive(spark, tmp_path):
    tracker = Tracker(SnapshotStore(spark, str(tmp_path)))
    now = datetime(2024, 1, 31)
    tracker.upload(roster_sheet(spark), contact_sheet(spark), datetime(2024, 1, 1))
    report = spark.createDataFrame(
        [("911111111", "2024-01-20 10:00:00", "L2B3S4_15", "Uso")],
        "`Numero Telefono` string, HoradeEntradaPantalla string, IDPantalla string, Registro string",
    )
    notes = spark.createDataFrame([("2", "llamar", now)], "id string, comment string, updated_at timestamp_ntz")
    update, first = tracker.store.update, []

    def delayed(version, build, *args, **kwargs):
        def after_a_comment(change):
            if not first:
                first.append(True)
                Tracker(SnapshotStore(spark, str(tmp_path))).comment(notes, now)
            return build(change)

        return update(version, after_a_comment, *args, **kwargs)

    tracker.store.update = delayed
    synced = tracker.sync(report, now)
    assert synced.rows["processed"] == 2 and synced.last_sync_at == now
    rows = {r.id: r for r in synced.tables["processed"].collect()}
    assert rows["2.0"].comments == "llamar" and rows["1"].completed


def test_search_by_index_finds_what_a_scan_finds(spark, tmp_path):
    draw = random.Random(4)
    people = [
        (i, str(i), f"Ana{i % 7}", None if i % 5 == 0 else f"SOTO{i % 11}ñÑ", None if i % 9 == 0 else f"9{draw.randrange(10**8):08d}")
        for i in range(400)
    ]
    rows = spark.createDataFrame(people, "row_no bigint, id string, adult_name string, adult_surname string, phone string")
    store = SnapshotStore(spark, str(tmp_path))
    tracker = Tracker(store)
    store.write("1", {"processed": rows, "original": rows})
    now, texts = datetime(2024, 1, 31), ["ana3 soto1", "ANA", "12", "1", "ñ", "oto4ñ", "zzz", "9", "399", "a1 s", "\\", "%"]
    plain = {t: text(tracker.search(now, t)) for t in texts}
    index = tracker.index(now)
    assert {t: text(tracker.search(now, t)) for t in texts} == plain
    assert text(tracker.search(now, "")) == text(tracker.search(now, "", "", "")) and tracker.search(now, "").count() == 400
    opened = searching.candidate_rows(store, index, "399").inputFiles()
    assert 0 < len(opened) < len(index.tables["search_rows"].inputFiles()) / 8
    notes = spark.createDataFrame([("399", "nota", now)], "id string, comment string, updated_at timestamp_ntz")
    tracker.comment(notes, now)
    assert "postings" not in tracker.current().tables and "nota" in {r.comments for r in tracker.search(now, "399").collect()}


def test_export_files_have_the_order_of_the_roster(spark, tmp_path):
    rows = spark.range(0, 5000, 1, 8).select(((F.col("id") * 7919) % 5000).alias("row_no"), F.array(F.lit("a")).alias("changed_columns"))
    folder = write_export(rows.repartition(8), str(tmp_path), date(2024, 1, 1))
    files = sorted((tmp_path / "2024-01-01" / "csv").glob("part-*"))
    found = [int(line.split(",")[0]) for f in files for line in f.read_text().splitlines()[1:]]
    assert found == list(range(5000))
    kept = [r.row_no for f in sorted((tmp_path / "2024-01-01" / "parquet").glob("part-*")) for r in spark.read.parquet(str(f)).collect()]
    assert kept == list(range(5000)) and folder.endswith("2024-01-01")
    assert [r.position - r.row_no for r in numbered(rows, "row_no").collect()] == [1] * 5000
    assert numbered(rows.where("false"), "row_no").count() == 0


def test_an_unchanged_roster_reads_no_time(spark, monkeypatch):
    people = spark.createDataFrame(
        [(1, "1", " Ana", "2024-01-20 09:00:00", "True", "12"), (2, "2", None, "nan", None, "x")],
        "row_no bigint, id string, school string, enrolled_at string, completed string, days string",
    )
    monkeypatch.setattr(cells, "parse_ts", lambda *_: F.raise_error(F.lit("a time was read")).cast("timestamp_ntz"))
    same = people.withColumn("school", F.upper("school"))  # of the same canonical form
    assert [r.change_kind for r in export_diff(same, people, CFG).collect()] == ["same", "same"]
    other = people.withColumn("school", F.lit("B")).withColumn("days", F.lit("12.0"))
    assert {r.row_no: r.changed_columns for r in export_diff(other, people, CFG).collect()} == {1: ["school"], 2: ["school", "days"]}
    late = people.withColumn("enrolled_at", F.lit("20-01-2024 09:00:00"))
    with pytest.raises(SparkRuntimeException, match="a time was read"):
        export_diff(late, people, CFG).collect()

"""Registered queries: every operator run over the given tables."""

from __future__ import annotations

import functools
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import table, view
from trailmark.config import (
    CONTACT_POSITIONS,
    CONTACTS_SKIP,
    DEFAULT_CONFIG,
    PARTICIPANT_HEADERS,
    ROSTER_SKIP,
)
from trailmark.functions.cells import differs
from trailmark.functions.numbers import round1, safe_float, safe_int_days
from trailmark.functions.screens import progress_pct, section_index, section_of
from trailmark.functions.text import normalise_id, null_if_missing, null_if_nan, phone_e164, with_phone_key
from trailmark.functions.timestamps import floor_days, parse_ts, swap_day_month
from trailmark.operators import comments as notes
from trailmark.operators import dashboard, export, searching, tallies
from trailmark.operators.logs import drop_noise, log_summary, valid_logs
from trailmark.operators.order import numbered
from trailmark.operators.participants import (
    clock,
    fill_first_log,
    join_activity,
    milestones,
)
from trailmark.operators.pending import pending_contacts
from trailmark.operators.schema import ensure_schema, processed_types
from trailmark.plans.live import fold_logs
from trailmark.plans.refresh import refresh, refresh_participants
from trailmark.session import tune
from trailmark.sources import keyed, secure, sheets
from trailmark.sources.log_scan import scan_logs
from trailmark.sources.snapshots import SnapshotStore
from trailmark.sources.workdir import new_folder, stored
from trailmark.streaming.comments import stream_comments
from trailmark.streaming.logs import stream_visits, streamed_summary
from trailmark.streaming.refresh import stream_refresh

CFG = DEFAULT_CONFIG
AS_OF = datetime(2024, 1, 31)

# Test keys, 32 bytes of text each.
KEY = "MDEyMzQ1Njc4OTAxMjM0NTY3ODkwMTIzNDU2Nzg5MDE="
WRONG_KEY = "YWJjZGVmZ2hpamFiY2RlZmdoaWphYmNkZWZnaGlqYWI="

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    """Register a query under its function name."""

    def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(tune(spark), sf_dir)

    QUERIES[run.__name__] = tuned
    return run


def _processed(spark: SparkSession, sf: str) -> DataFrame:
    roster, logs = view(spark, sf, "fx_participants"), view(spark, sf, "fx_logs")
    return refresh_participants(roster, log_summary(logs, CFG), AS_OF, CFG)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.records(_processed(spark, sf), AS_OF, CFG)


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """A refresh read back from its snapshot, as lists, searches and exports do: their filters
    reach its files, and what they read twice is not computed twice."""
    store = SnapshotStore(spark, new_folder(spark, "snapshots"))
    store.write("2024-01-31", {"processed": _processed(spark, sf)}, AS_OF)
    return store.load(CFG).tables["processed"]


def _stored_records(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.records(_stored(spark, sf), AS_OF, CFG)


# --- Scans, sheets, snapshots ------------------------------------------------


def _sheet(spark: SparkSession, data: DataFrame, headers: list[str], skip: int, name: str) -> DataFrame:
    """Data as an exported sheet: title rows, a header row, then the data, all text."""
    cells = [c for c in data.columns if c != "row_no"]
    titles = spark.range(1, skip + 1).select(
        F.col("id").alias("row_no"), F.lit("Informe").alias(cells[0]), *[F.lit(None).cast("string").alias(c) for c in cells[1:]]
    )
    header = spark.range(skip + 1, skip + 2).select(
        F.col("id").alias("row_no"), *[F.lit(h).alias(c) for c, h in zip(cells, headers, strict=True)]
    )
    body = data.withColumn("row_no", F.col("row_no") + skip + 2)
    folder = new_folder(spark, name)
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    titles.unionByName(header).unionByName(body).write.csv(folder, header=True, **blanks)
    kinds = ", ".join(f"{c} {'bigint' if c == 'row_no' else 'string'}" for c in titles.columns)
    return spark.read.csv(folder, header=True, schema=kinds)


@query
def roster_scan(spark, sf):
    people = view(spark, sf, "fx_participants")
    nameless = view(spark, sf, "fx_contacts").select(
        (F.col("row_no") + 2 * 10**12).alias("row_no"), F.lit(None).cast("string").alias("id"), "school"
    )
    header_of = {n: h for h, n in PARTICIPANT_HEADERS.items()}
    headers = [header_of[c] for c in people.columns if c != "row_no"]
    data = people.unionByName(nameless, allowMissingColumns=True)
    return sheets.read_roster(_sheet(spark, data, headers, ROSTER_SKIP, "roster"))


@query
def contacts_scan(spark, sf):
    contacts = view(spark, sf, "fx_contacts")
    width = max(CONTACT_POSITIONS) + 1
    cells = [
        F.col(CONTACT_POSITIONS[p]).alias(f"c{p}") if p in CONTACT_POSITIONS else F.lit(None).cast("string").alias(f"c{p}")
        for p in range(width)
    ]
    headers = [CONTACT_POSITIONS.get(p, f"Otro {p}") for p in range(width)]
    sheet = _sheet(spark, contacts.select("row_no", *cells), headers, CONTACTS_SKIP, "contacts")
    return sheets.read_contacts(sheet)


@query
def log_scan_range(spark, sf):
    events = table(spark, sf, "events")
    return scan_logs(events, date(2024, 1, 10), datetime(2024, 1, 21, 15), CFG, "ts").select("event_id", "ts")


@query
def log_scan_text(spark, sf):
    """The same bounds on times written as text."""
    logs = view(spark, sf, "fx_logs")
    return scan_logs(logs, date(2024, 1, 10), datetime(2024, 1, 21, 15), CFG).select("event_id", "entered_at")


@query
def snapshot_roundtrip(spark, sf):
    store = SnapshotStore(spark, new_folder(spark, "snapshots"))
    original, contacts = view(spark, sf, "fx_participants"), view(spark, sf, "fx_contacts")
    processed, pending = refresh(original, contacts, view(spark, sf, "fx_logs"), AS_OF, CFG)
    tables = {"processed": processed, "original": original, "contacts": contacts, "pending": pending}
    store.write("2024-01-31", tables, AS_OF)
    return store.load(CFG).tables["processed"]


def _unprocessed(spark, sf):
    return view(spark, sf, "fx_participants").select("row_no", "id", "school", "phone", "state")


@query
def snapshot_fallback(spark, sf):
    store = SnapshotStore(spark, new_folder(spark, "snapshots"))
    original = _unprocessed(spark, sf)
    store.write("2024-01-30", {"processed": original, "original": original}, AS_OF)
    store.write("2024-01-31", {"processed": original.where(F.lit(False)), "original": original}, AS_OF)
    snapshot = store.load(CFG)
    return snapshot.tables["processed"].withColumn("last_sync_at", F.lit(snapshot.last_sync_at).cast("timestamp_ntz"))


@query
def upsert_latest(spark, sf):
    """A table with one row per key, stored, and new rows for it."""
    old, new = view(spark, sf, "fx_state_old"), view(spark, sf, "fx_state_new")
    old, new = (df.withColumn("content", F.encode("content", "utf-8")) for df in (old, new))
    table = stored(keyed.latest(old), "keyed")
    return keyed.upsert_latest(table, new).withColumn("content", F.decode("content", "utf-8"))


@query
def pii_roundtrip(spark, sf):
    hidden = ["phone", "adult_name"]
    sealed = secure.encrypt_columns(
        view(spark, sf, "fx_participants").select("row_no", "id", *hidden, F.col("phone").alias("sealed")),
        [*hidden, "sealed"],
        KEY,
    )
    opened = secure.decrypt_columns(sealed.withColumn("other", F.col("adult_name")), hidden, KEY)
    return (
        secure.decrypt_columns(opened, ["other"], WRONG_KEY)
        .withColumn("wrong_key_fails", F.col("other").isNull())
        .withColumn("cipher_bytes", F.octet_length("sealed"))
        .drop("other", "sealed")
    )


@query
def retain_versions(spark, sf):
    events = table(spark, sf, "events")
    versions = events.select("event_id", F.to_date("ts").alias("version"))
    return keyed.retain_versions(versions, "version", CFG.retained_versions)


# --- Schema and columns ------------------------------------------------------


@query
def ensure_schema_query(spark, sf):
    return ensure_schema(_unprocessed(spark, sf), CFG)


QUERIES["ensure_schema"] = QUERIES.pop("ensure_schema_query")


@query
def null_normalise(spark, sf):
    texts, numbers = view(spark, sf, "fx_texts"), view(spark, sf, "fx_numbers")
    events = table(spark, sf, "events").select("event_id", "value")
    rows = texts.join(numbers.withColumnRenamed("text", "number"), "event_id").join(events, "event_id")
    gaps = F.when(null_if_missing(F.col("number")).isNull(), F.lit(float("nan"))).otherwise(F.col("value"))
    return rows.select(
        "event_id",
        null_if_missing(F.col("text")).alias("text"),
        null_if_missing(F.col("number")).alias("number"),
        null_if_nan(gaps).alias("value"),
    )


@query
def phone_keys(spark, sf):
    logs = with_phone_key(view(spark, sf, "fx_logs"), "phone")
    return logs.select("event_id", "phone_key", phone_e164(F.col("phone")).alias("phone_e164"))


@query
def id_normalise(spark, sf):
    sources = {"c": "fx_contacts", "p": "fx_participants"}
    parts = [
        view(spark, sf, v).select(F.lit(s).alias("source"), "row_no", normalise_id(F.col("id")).alias("id"))
        for s, v in sources.items()
    ]
    return parts[0].unionByName(parts[1])


@query
def parse_timestamps(spark, sf):
    return view(spark, sf, "fx_texts").withColumn("parsed", parse_ts(F.col("text")))


@query
def parse_enrolment(spark, sf):
    read = view(spark, sf, "fx_texts").withColumn("read", parse_ts(F.col("text")))
    return read.select("event_id", swap_day_month(F.col("read")).alias("enrolled_on"))


@query
def screen_progress(spark, sf):
    screen = F.col("screen")
    return view(spark, sf, "fx_logs").select(
        "event_id",
        "screen",
        section_of(screen).alias("section"),
        section_index(section_of(screen), CFG).alias("section_index"),
        progress_pct(screen, CFG).alias("progress_pct"),
    )


@query
def elapsed_days(spark, sf):
    now, at = clock(AS_OF), F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", floor_days(now, at).alias("days_since"), floor_days(at, now).alias("days_until")
    )


@query
def safe_numbers(spark, sf):
    text = F.col("text")
    return view(spark, sf, "fx_numbers").select(
        "event_id",
        safe_float(text).alias("as_float"),
        safe_int_days(text).alias("as_days"),
        round1(safe_float(text) / 8).alias("rounded"),
    )


@query
def cell_differs(spark, sf):
    return view(spark, sf, "fx_pairs").withColumn("differs", differs(F.col("a"), F.col("b")))


@query
def screen_labels(spark, sf):
    logs = view(spark, sf, "fx_logs").withColumn("current_screen", F.col("screen"))
    return dashboard.screen_labels(logs, CFG).select("event_id", "screen", "screen_label")


# --- Logs --------------------------------------------------------------------


@query
def log_noise_filter(spark, sf):
    return drop_noise(view(spark, sf, "fx_logs"), CFG)


@query
def log_valid(spark, sf):
    return valid_logs(view(spark, sf, "fx_logs"), CFG).select("event_id", "phone_key", "visited_at", "screen")


@query
def log_summary_query(spark, sf):
    return log_summary(view(spark, sf, "fx_logs"), CFG)


QUERIES["log_summary"] = QUERIES.pop("log_summary_query")


# --- Participants ------------------------------------------------------------


@query
def participant_activity(spark, sf):
    return _processed(spark, sf).select(
        "row_no", "id", "first_log_text", "first_log_at", "first_log_date", "week4_on", "week6_on", "week4_eval",
        "week6_eval", "last_used_at", "days_since_use", "days_elapsed", "expected_end_at", "current_screen", "progress_pct",
    )


@query
def milestones_query(spark, sf):
    people = processed_types(view(spark, sf, "fx_participants"), CFG)
    seen = fill_first_log(join_activity(people, log_summary(view(spark, sf, "fx_logs"), CFG)))
    return milestones(seen, AS_OF, CFG).select(
        "row_no", "id", "first_log_at", "first_log_date", "expected_end_at", "days_elapsed", "week4_on", "week6_on",
        "week4_eval", "week6_eval",
    )


QUERIES["milestones"] = QUERIES.pop("milestones_query")


@query
def completion(spark, sf):
    return _processed(spark, sf).select("row_no", "id", "completed", "progress_pct", "finished_at")


@query
def funnel_status(spark, sf):
    return _processed(spark, sf).select("row_no", "id", "status", "status_ordered")


@query
def refresh_query(spark, sf):
    processed, _ = refresh(
        view(spark, sf, "fx_participants"), view(spark, sf, "fx_contacts"), view(spark, sf, "fx_logs"), AS_OF, CFG
    )
    return processed


QUERIES["refresh"] = QUERIES.pop("refresh_query")


@query
def refresh_again(spark, sf):
    """A refresh whose input is the snapshot of a refresh."""
    store = SnapshotStore(spark, new_folder(spark, "snapshots"))
    store.write("1", {"processed": _processed(spark, sf)}, AS_OF)
    summary = log_summary(view(spark, sf, "fx_logs"), CFG)
    return refresh_participants(store.read().tables["processed"], summary, AS_OF, CFG)


@query
def refresh_counts(spark, sf):
    """Counters taken while the refresh is written."""
    store = SnapshotStore(spark, new_folder(spark, "snapshots"))
    roster, contacts = view(spark, sf, "fx_participants"), view(spark, sf, "fx_contacts")
    processed, pending = refresh(roster, contacts, view(spark, sf, "fx_logs"), AS_OF, CFG)
    return dashboard.written_counts(store.write("2024-01-31", {"processed": processed, "pending": pending}, AS_OF), spark)


@query
def pending_contacts_query(spark, sf):
    return pending_contacts(view(spark, sf, "fx_contacts"), view(spark, sf, "fx_participants"), CFG)


QUERIES["pending_contacts"] = QUERIES.pop("pending_contacts_query")


# --- Dashboard ---------------------------------------------------------------


@query
def records(spark, sf):
    return _records(spark, sf)


@query
def funnel_counts(spark, sf):
    return dashboard.funnel_counts(_processed(spark, sf), CFG)


@query
def section_counts(spark, sf):
    return dashboard.section_counts(_processed(spark, sf), CFG)


@query
def school_stats(spark, sf):
    return dashboard.school_stats(_processed(spark, sf))


@query
def kpis(spark, sf):
    return dashboard.kpis(_processed(spark, sf), CFG)


@query
def cohort_weeks(spark, sf):
    return dashboard.cohort_weeks(_processed(spark, sf), AS_OF, CFG).select("row_no", "id", "weeks_enrolled", "bucket")


@query
def cohort_counts(spark, sf):
    return dashboard.cohort_counts(_processed(spark, sf), AS_OF, CFG)


@query
def cohort_status(spark, sf):
    return dashboard.cohort_status(_processed(spark, sf), AS_OF, CFG)


@query
def cohort_members(spark, sf):
    """Rows behind the last, open-ended bar of the cohort chart."""
    return dashboard.cohort_members(_processed(spark, sf), 7, AS_OF, CFG).select("row_no", "id", "weeks_enrolled", "bucket")


@query
def filter_values(spark, sf):
    return dashboard.filter_values(_processed(spark, sf))


@query
def call_lists(spark, sf):
    return dashboard.call_lists(_stored_records(spark, sf), CFG)


@query
def call_list_counts(spark, sf):
    return dashboard.call_list_counts(_processed(spark, sf), CFG)


@query
def search_participants(spark, sf):
    return dashboard.search(_stored_records(spark, sf), "ANA1", "BUILDING", "Notificado - No Descarga App")


@query
def participant_card(spark, sf):
    return dashboard.cards(_records(spark, sf))


@query
def participant_card_of(spark, sf):
    """The card of the participant with the smallest id."""
    rows = _stored_records(spark, sf)
    return dashboard.card(rows, rows.agg(F.min("id")).first()[0])


# --- Export and comments -----------------------------------------------------


@query
def export_rows(spark, sf):
    return export.export_rows(_processed(spark, sf))


@query
def export_diff(spark, sf):
    rows = export.export_diff(_stored(spark, sf), view(spark, sf, "fx_original"), CFG)
    return rows.select(
        "row_no",
        normalise_id(F.col("id")).alias("match_id"),
        "status",
        "change_kind",
        F.concat_ws(",", "changed_columns").alias("changed_columns"),
    )


@query
def export_written(spark, sf):
    """The export read back from the CSV files of its day."""
    rows = export.export_diff(_stored(spark, sf), view(spark, sf, "fx_original"), CFG)
    folder = export.write_export(rows, new_folder(spark, "export"), AS_OF.date())
    written = spark.read.csv(f"{folder}/csv", header=True, escape='"')
    # the place of a row in the files, in the order of their names
    written = numbered(
        written.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")),
        "_file", "_block", "_at",
    )
    return written.select(
        "position",
        F.col("row_no").cast("bigint").alias("row_no"),
        normalise_id(F.col("id")).alias("match_id"),
        "status",
        "change_kind",
        F.coalesce("changed_columns", F.lit("")).alias("changed_columns"),
    )


@query
def apply_comments(spark, sf):
    people = view(spark, sf, "fx_participants")
    return notes.apply_comments(people, view(spark, sf, "fx_comments")).select("row_no", "id", "comments")


@query
def unmatched_comments(spark, sf):
    return notes.unmatched_comments(view(spark, sf, "fx_participants"), view(spark, sf, "fx_comments"))


# --- Streams -----------------------------------------------------------------


def _stream_of(spark: SparkSession, rows: DataFrame, name: str, files: int = 4) -> DataFrame:
    """A table as a stream of several files, one per batch."""
    folder = new_folder(spark, name)
    rows.repartition(files).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query
def stream_log_summary(spark, sf):
    out = new_folder(spark, "visits")
    logs = _stream_of(spark, view(spark, sf, "fx_logs"), "log-files")
    stream_visits(logs, out, new_folder(spark, "state"), CFG).awaitTermination()
    return streamed_summary(spark, out, CFG)


@query
def stream_refresh_query(spark, sf):
    store = SnapshotStore(spark, new_folder(spark, "snapshots"))
    logs = _stream_of(spark, view(spark, sf, "fx_logs"), "log-files", 2)
    stream_refresh(
        logs,
        view(spark, sf, "fx_participants"),
        store,
        new_folder(spark, "state"),
        lambda: AS_OF,
        CFG,
    ).awaitTermination()
    return store.load(CFG).tables["processed"]


QUERIES["stream_refresh"] = QUERIES.pop("stream_refresh_query")


@query
def stream_comments_query(spark, sf):
    store = SnapshotStore(spark, new_folder(spark, "snapshots"))
    store.write("1", {"processed": view(spark, sf, "fx_participants")}, AS_OF)
    written = _stream_of(spark, view(spark, sf, "fx_comments"), "comment-files")
    stream_comments(written, store, new_folder(spark, "state"), CFG).awaitTermination()
    return store.read().tables["processed"].select("row_no", "id", "comments")


QUERIES["stream_comments"] = QUERIES.pop("stream_comments_query")


@query
def stream_unmatched(spark, sf):
    """Comments of a stream whose id no participant has."""
    store = SnapshotStore(spark, new_folder(spark, "snapshots"))
    store.write("1", {"processed": view(spark, sf, "fx_participants")}, AS_OF)
    written = _stream_of(spark, view(spark, sf, "fx_comments"), "comment-files", 2)
    stream_comments(written, store, new_folder(spark, "state"), CFG).awaitTermination()
    return store.read().tables["unmatched"]


def _three_portions(spark: SparkSession, sf: str) -> SnapshotStore:
    """A store that got the logs in three portions, late ones first."""
    store = SnapshotStore(spark, new_folder(spark, "snapshots"))
    logs, people = view(spark, sf, "fx_logs"), view(spark, sf, "fx_participants")
    for i in (2, 0, 1):
        fold_logs(store, logs.where(F.col("event_id") % 3 == i), AS_OF, f"portion {i}", CFG, people)
    return store


@query
def refresh_by_portions(spark, sf):
    """The refresh by three portions of logs, each of which rewrites only the buckets of its phones."""
    return _three_portions(spark, sf).read().tables["processed"]


@query
def kept_counts(spark, sf):
    """All counts of the dashboard from tallies that three portions changed by differences, in one long table."""
    kept = _three_portions(spark, sf).read().tables["tallies"]
    text = lambda c: F.col(c).cast("string")
    parts = {
        "stage": tallies.funnel_counts(kept, CFG).select(text("stage").alias("a"), F.lit("").alias("b"), "n"),
        "section": tallies.section_counts(kept, CFG).select(text("section"), F.lit(""), "n"),
        "school total": tallies.school_stats(kept).select("school", F.lit(""), "total"),
        "school completed": tallies.school_stats(kept).select("school", F.lit(""), "completed"),
        "cohort": tallies.cohort_counts(kept, AS_OF, CFG).select(text("bucket"), F.lit(""), "n"),
        "cohort status": tallies.cohort_status(kept, AS_OF, CFG).select(text("bucket"), "status", "n"),
        "call list": tallies.call_list_counts(kept, CFG).select("call_list", F.lit(""), "n"),
        "filter": tallies.filter_values(kept).select("filter", "value", F.lit(1).cast("bigint")),
    }
    whole = tallies.kpis(kept, CFG)
    for name in whole.columns:
        parts[f"all {name}"] = whole.select(F.lit(""), F.lit(""), name)
    rows = [df.toDF("a", "b", "n").select(F.lit(name).alias("measure"), "a", "b", "n") for name, df in parts.items()]
    return functools.reduce(DataFrame.union, rows)


def _indexed(spark: SparkSession, sf: str, text: str) -> DataFrame:
    store = SnapshotStore(spark, new_folder(spark, "snapshots"))
    store.write("1", {"processed": _processed(spark, sf)}, AS_OF)

    def build(change):
        searching.put_index(change, dashboard.records(change.table("processed"), AS_OF, CFG))

    found = searching.candidate_rows(store, store.update("index", build, AS_OF), text)
    return dashboard.search(found, text)


@query
def search_indexed(spark, sf):
    """Search by runs of three characters; few rows are found."""
    return _indexed(spark, sf, "A12 Soto1")


@query
def search_indexed_many(spark, sf):
    """The same with a text that more rows have than are named to the scan one by one."""
    return _indexed(spark, sf, "Ana")


@query
def search_indexed_short(spark, sf):
    """The same with a text of two characters."""
    return _indexed(spark, sf, "77")

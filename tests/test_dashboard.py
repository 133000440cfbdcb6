"""Dashboard parts on a small processed roster."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

import pytest

from trailmark.config import DEFAULT_CONFIG as CFG
from trailmark.config import Statuses
from trailmark.operators import dashboard as D
from trailmark.plans.dashboard import dashboard_tables
from trailmark.plans.refresh import refresh

AS_OF = datetime(2024, 1, 31)
ROWS = [
    # id, school, name, surname, phone, enrolled, first log, screen, progress, days, completed, status
    ("1.0", "A", "Ana", "Soto", "911", "31-01-2024", "2024-01-20 09:00:00", "L2B3S4_15", "100", "1", "True", "Completado"),
    ("2", "A", "Eva", None, None, "17-01-2024", "2024-01-01", "L1B2S1_3", "12.5", "1900-01-05", "False", "En Progreso - Atrasado"),
    ("3", "B", "Leo", "Rey", "933", "20-11-2023", None, None, None, None, None, "Notificado - No Descarga App"),
    (None, "B", "Sol", "Rey", "944", None, "pendiente", "X9Z9", "6.25", None, "True", "En Libro 1"),
    ("5", None, "Luz", "", "955", "no date", "2024-01-30", "L1B2S1_9", "18.75", "0", "no", "En Libro 1"),
]
SCHEMA = (
    "id string, school string, adult_name string, adult_surname string, phone string, enrolled_at string, first_log_at string, "
    "current_screen string, progress_pct string, days_since_use string, completed string, status string"
)


@pytest.fixture(scope="module")
def people(spark):
    return D.dashboard_input(spark.createDataFrame(ROWS, SCHEMA), CFG).persist()


def test_records(people):
    rows = {r.name: r for r in D.records(people, AS_OF, CFG).collect()}
    ana, eva, sol = rows["Ana Soto"], rows["Eva"], rows["Sol Rey"]
    assert (ana.id, ana.enrolled_on, ana.weeks_enrolled, ana.first_log_on) == ("1", "2024-01-31", 0, "2024-01-20")
    assert (eva.progress, eva.days_since_use, eva.completed, eva.weeks_enrolled) == (12.5, 6, False, 2)
    assert (sol.id, sol.first_log_on, sol.progress, sol.completed) == ("", "pendiente", 6.2, True)
    assert rows["Luz"].progress == 18.8
    assert len(D.records(people, AS_OF, CFG).columns) == 16


def test_counts(people):
    assert {r.stage: r.n for r in D.funnel_counts(people, CFG).collect() if r.n} == {
        "3. Notificados No Descargan": 1,
        "5. En Progreso Atrasados": 1,
        "6. En Libro 1": 2,
        "9. Completados": 1,
    }
    funnel = D.funnel_counts(people, CFG).collect()
    assert [r.position for r in funnel] == list(range(9)) and funnel[0].label == "Rechazo / Sin disponibilidad"
    sections = D.section_counts(people, CFG).collect()
    assert [r.section for r in sections] == CFG.sections
    assert {r.section: r.n for r in sections if r.n} == {"L1B2S1": 2}
    assert D.kpis(people, CFG).first().asDict() == {"total": 5, "completed": 2, "active": 2, "late": 1}
    assert [r.n for r in D.cohort_counts(people, AS_OF, CFG).collect()] == [1, 0, 1, 0, 0, 0, 0, 1]
    assert {r.call_list: r.n for r in D.call_list_counts(people, CFG).collect()} == {
        "late": 1,
        "no_download": 1,
        "confirm_completed": 1,
    }


def test_no_active_participants_still_show_all_sections(people):
    assert [r.n for r in D.section_counts(people.where("false"), CFG).collect()] == [0] * 16


def test_schools(people):
    assert [tuple(r) for r in D.school_stats(people).collect()] == [("B", 1, 1, 0, 100.0), ("A", 2, 1, 1, 50.0)]


def test_cohorts(people):
    got = [tuple(r) for r in D.cohort_status(people, AS_OF, CFG).collect()]
    assert got == [(0, "Completado", 1), (2, "En Progreso - Atrasado", 1), (7, "Notificado - No Descarga App", 1)]
    assert [r.id for r in D.cohort_members(people, 7, AS_OF, CFG).collect()] == ["3"]


def test_lists_search_and_cards(people):
    rows = D.records(people, AS_OF, CFG)
    assert {r.id: r.call_list for r in D.call_lists(rows, CFG).collect()} == {
        "1": "confirm_completed",
        "2": "late",
        "3": "no_download",
    }
    assert {r.name for r in D.search(rows, "REY").collect()} == {"Leo Rey", "Sol Rey"}
    assert {r.name for r in D.search(rows, "95").collect()} == {"Luz"}
    assert {r.name for r in D.search(rows, "", "A", "Completado").collect()} == {"Ana Soto"}
    assert D.search(rows).count() == 5
    one = D.card(rows, "1").first()
    assert (one.badge, one.last_active) == ("completed", "2024-01-20")
    assert D.card(rows, "3").first().last_active == "Sin actividad"


def test_filter_values(people):
    got = [tuple(r) for r in D.filter_values(people).collect()]
    assert got[:2] == [("school", "A"), ("school", "B")] and len(got) == 6


def test_all_tables_work_on_an_unprocessed_roster(spark):
    roster = spark.createDataFrame([("1", "A", "9", None)], "id string, school string, phone string, state string")
    tables = dashboard_tables(roster, AS_OF)
    assert tables["records"].first().status == "Desconocido"
    assert {n: t.count() for n, t in tables.items()} == {
        "last_sync": 1, "records": 1, "kpis": 1, "funnel": 9, "sections": 16, "schools": 1, "cohorts": 8, "cohort_status": 0,
        "call_lists": 0, "call_list_counts": 3, "filter_values": 2, "cards": 1,
    }


def test_another_programme(spark):
    """Other statuses in another order, other sections, labels and wording: no code knows the first programme."""
    names = Statuses(*(f"s-{n}" for n in "rejected recent absent failed late first second near done".split()))
    order = [names.done, names.near_end, names.second_half, names.first_half, names.late, names.failed, names.absent, names.recent, names.rejected]
    cfg = replace(
        CFG,
        statuses=names,
        status_labels={s: f"{i}. {s[2:]}" for i, s in enumerate(order, 1)},
        section_labels={"AA": "first part", "BB": "last part"},
        final_screens=("BB_9",),
        call_lists={"late": (names.late,), "ready": (names.done,)},
        active_status_pattern="s-first|s-second|s-near",
        badges={"done": "ok"},
        cohort_labels=("new", "old"),
        no_activity="none yet",
        unknown="?",
        evaluable_since="since ",
        evaluable_from="from ",
    )
    people = spark.createDataFrame(
        [("1", "911111111", None, None), ("2", "922222222", None, None), ("3", "933333333", None, "2024-01-30"), ("4", "944444444", "no quieren", None)],
        "id string, phone string, state string, enrolled_at string",
    )
    logs = spark.createDataFrame(
        [("911111111", "2024-01-20 10:00:00", "BB_9", None), ("922222222", "2024-01-25 10:00:00", "AA_1", None)],
        "phone string, entered_at string, screen string, entry string",
    )
    done, _ = refresh(people, None, logs, datetime(2024, 1, 31), cfg)
    rows = {r.id: r for r in done.collect()}
    assert {i: r.status for i, r in rows.items()} == {"1": "s-done", "2": "s-second", "3": "s-recent", "4": "s-rejected"}
    assert rows["1"].status_ordered == "1. done" and rows["1"].progress_pct == 100.0 and rows["2"].progress_pct == 50.0
    assert rows["1"].week4_eval == "from 17/02/2024"
    tables = dashboard_tables(done, datetime(2024, 1, 31), cfg)
    assert [(r.section, r.n) for r in tables["sections"].orderBy("position").collect()] == [("AA", 1), ("BB", 0)]
    assert [(r.label, r.n) for r in tables["cohorts"].orderBy("bucket").collect()] == [("new", 1), ("old", 0)]
    assert {r.call_list: r.n for r in tables["call_list_counts"].collect()} == {"late": 0, "ready": 1}
    cards = {r.id: (r.badge, r.last_active) for r in tables["cards"].collect()}
    assert cards["1"] == ("ok", "2024-01-20") and cards["3"] == ("other", "none yet")

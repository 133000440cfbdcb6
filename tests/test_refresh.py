"""Refresh, rule by rule."""

from __future__ import annotations

from datetime import date, datetime

import pytest

from trailmark.config import DEFAULT_CONFIG as CFG
from trailmark.operators.dashboard import refresh_counts
from trailmark.operators.logs import log_summary
from trailmark.operators.pending import pending_contacts
from trailmark.operators.schema import PARTICIPANT_TYPES, ensure_schema, processed_types
from trailmark.plans.refresh import refresh, refresh_participants

AS_OF = datetime(2024, 1, 31)
LOG = "phone string, entered_at string, screen string, entry string"


def roster(spark, *rows):
    """Rows as dictionaries; every row gets an id and a phone of its own."""
    names = sorted({k for r in rows for k in r} | {"id", "phone", "state"})
    data = [
        tuple({"id": str(i), "phone": f"9{i:08d}", "state": None, **r}.get(n) for n in names) for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(data, ", ".join(f"{n} string" for n in names))


def run(spark, people, logs=(), as_of=AS_OF):
    table = spark.createDataFrame([(f"9{i:08d}", at, screen, None) for i, at, screen in logs], LOG)
    out = refresh_participants(people, log_summary(table, CFG), as_of, CFG)
    return {int(r.id): r for r in out.collect()}


def test_funnel_rules(spark):
    long_ago, lately = "2023-12-20 10:00:00", "2024-01-25 10:00:00"
    cases = [
        ({"state": "Error en la app, rechaza"}, None, "4. Notificados con Error Técnico"),
        ({"state": "Trabaja mucho"}, None, "1. Rechazo / Sin disponibilidad"),
        ({"state": "RECHAZA"}, (lately, "L1B1S0_15"), "1. Rechazo / Sin disponibilidad"),
        ({"enrolled_at": "26-01-2024"}, None, "2. Recién Notificados"),
        ({"enrolled_at": "25-01-2024"}, None, "3. Notificados No Descargan"),
        ({"enrolled_at": "2024-01-02"}, None, "3. Notificados No Descargan"),
        ({}, None, "3. Notificados No Descargan"),
        ({}, (lately, "L2B3S4_15"), "9. Completados"),
        ({}, (lately, "L2B2S2_3"), "8. Próximos a Terminar (Avanzados)"),
        ({}, (long_ago, "L1B3S4_14"), "7. Empezando Libro 2"),
        ({}, (long_ago, "L1B2S2_3"), "5. En Progreso Atrasados"),
        ({}, (lately, "L1B2S2_3"), "6. En Libro 1"),
        ({"state": "falso completado"}, (lately, "L2B3S4_15"), "8. Próximos a Terminar (Avanzados)"),
        ({"first_log_at": "pendiente", "current_screen": "L2B3S4_15"}, None, "6. En Libro 1"),
        ({"completed": "True"}, None, "3. Notificados No Descargan"),
    ]
    logs = [(i, *log) for i, (_, log, _) in enumerate(cases) if log]
    got = run(spark, roster(spark, *[c for c, _, _ in cases]), logs)
    assert [got[i].status_ordered for i in range(len(cases))] == [stage for *_, stage in cases]


def test_milestones_and_activity(spark):
    logs = [(0, "2024-01-01T10:00:00.750", "L1B1S0_15"), (0, "2024-01-30 23:30:00:500", "L1B2S1_3")]
    row = run(spark, roster(spark, {}), logs)[0]
    assert row.first_log_text == "2024-01-01 10:00:00"
    assert row.first_log_at == datetime(2024, 1, 1, 10)
    assert row.first_log_date == date(2024, 1, 1)
    assert row.expected_end_at == datetime(2024, 1, 15, 10)
    assert (row.week4_on, row.week6_on) == (date(2024, 1, 29), date(2024, 2, 12))
    assert (row.week4_eval, row.week6_eval) == ("SÍ, DESDE EL 29/01/2024", "NO, SE PODRÁ EL 12/02/2024")
    assert (row.days_elapsed, row.days_since_use) == (29, 0)
    assert row.last_used_at == datetime(2024, 1, 30, 23, 30)
    assert (row.current_screen, row.progress_pct, row.completed) == ("L1B2S1_3", 12.5, None)


def test_use_after_the_clock_counts_as_minus_one_day(spark):
    row = run(spark, roster(spark, {}), [(0, "2024-01-31 01:00:00", "L1B1S0_15")])[0]
    assert (row.days_since_use, row.days_elapsed) == (-1, -1)


def test_first_log_of_the_roster_stays(spark):
    people = roster(spark, {"first_log_at": "05-12-2023"}, {"first_log_at": "nan"})
    got = run(spark, people, [(i, "2024-01-20 08:00:00", "L1B1S0_15") for i in (0, 1)])
    assert (got[0].first_log_at, got[0].first_log_text) == (datetime(2023, 12, 5), "05-12-2023")
    assert got[1].first_log_at == datetime(2024, 1, 20, 8)


def test_unseen_participants_are_reset_and_roster_screens_protect(spark):
    known = {"first_log_at": "2024-01-20", "progress_pct": "50", "days_since_use": "3", "week4_on": "2024-02-17"}
    got = run(spark, roster(spark, known, {**known, "current_screen": "L1B2S1_3"}, {**known, "current_screen": " nan "}))
    for i in (0, 2):
        assert (got[i].first_log_text, got[i].week4_on, got[i].days_since_use) == (None, None, None)
        assert got[i].progress_pct == 0.0
    assert (got[1].first_log_at, got[1].progress_pct, got[1].days_since_use) == (datetime(2024, 1, 20), 50.0, 3)


def test_logs_without_screens_keep_roster_values(spark):
    people = roster(spark, {"current_screen": "L1B2S1_3", "progress_pct": "12.5", "last_used_at": "2024-01-02"})
    row = run(spark, people, [(0, "2024-01-20 08:00:00", None)])[0]
    assert (row.current_screen, row.progress_pct, row.last_used_at) == ("L1B2S1_3", 12.5, datetime(2024, 1, 2))
    assert row.first_log_at == datetime(2024, 1, 20, 8)


def test_completion(spark):
    final = ("2024-01-20 08:00:00", "L2B3S4_15")
    cases = [
        ({}, final, (True, 100.0, datetime(2024, 1, 20, 8))),
        ({"completed": "True", "finished_at": "2024-01-05"}, None, (True, 100.0, AS_OF)),
        ({"completed": "1"}, final, (True, 100.0, datetime(2024, 1, 20, 8))),
        ({"state": "desiste", "finished_at": "2024-01-05"}, final, (None, 100.0, datetime(2024, 1, 5))),
        ({"state": "No completado", "completed": "True", "finished_at": "2024-01-05"}, final, (False, 93.8, None)),
        ({"completed": "nan"}, None, (None, 0.0, None)),
        ({"completed": "False"}, None, (False, 0.0, None)),
    ]
    logs = [(i, *log) for i, (_, log, _) in enumerate(cases) if log]
    got = run(spark, roster(spark, *[c for c, _, _ in cases]), logs)
    assert [(got[i].completed, got[i].progress_pct, got[i].finished_at) for i in range(len(cases))] == [
        e for *_, e in cases
    ]


def test_shared_and_unusable_phones(spark):
    people = roster(spark, {"phone": "+56 9 0000 0007"}, {"phone": "900000007.0"}, {"phone": "7"}, {"phone": None})
    got = run(spark, people, [(7, "2024-01-20 08:00:00", "L1B1S0_15")])
    assert [got[i].first_log_at is not None for i in range(4)] == [True, True, False, False]


def test_empty_log_changes_nothing_but_the_reset(spark):
    got = run(spark, roster(spark, {"first_log_at": "2024-01-20", "current_screen": "L1B1S0"}, {}))
    assert (got[0].status, got[1].status) == ("En Libro 1", "Notificado - No Descarga App")


def test_refreshing_a_stored_refresh_changes_nothing(spark, tmp_path):
    people = roster(
        spark,
        {"completed": "True", "enrolled_at": "05/01/2024"},
        {"first_log_at": "pendiente", "current_screen": "L1B1S0", "school": "A"},
        {"state": "falso", "finished_at": "2024-01-03", "comments": "x"},
        {},
    )
    logs = spark.createDataFrame(
        [("900000002", "2024-01-20 08:00:00", "L2B3S4_15", None), ("900000003", "2024-01-21 08:00:00", "L1B2S2_3", None)], LOG
    )
    summary = log_summary(logs, CFG)
    refresh_participants(people, summary, AS_OF, CFG).write.parquet(str(tmp_path / "once"))
    once = spark.read.parquet(str(tmp_path / "once"))
    twice = refresh_participants(once, summary, AS_OF, CFG)
    assert twice.dtypes == once.dtypes
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))


def test_types_of_a_processed_roster(spark):
    df = processed_types(roster(spark, {"extra": "kept"}), CFG)
    assert dict(df.dtypes) == {**PARTICIPANT_TYPES, "extra": "string"}
    assert df.first().extra == "kept"
    assert processed_types(df, CFG).dtypes == df.dtypes


def test_schema_defaults(spark):
    df = ensure_schema(spark.createDataFrame([("En Libro 1",), ("?",)], "status string"), CFG)
    rows = df.collect()
    assert [r.status_ordered for r in rows] == ["6. En Libro 1", "Desconocido"]
    assert (rows[0].school, rows[0].id, rows[0].comments, rows[0].completed) == ("Desconocido", "", "", False)
    assert ensure_schema(spark.createDataFrame([("1",)], "id string"), CFG).first().status == "Desconocido"


def test_required_columns_and_zone(spark):
    with pytest.raises(ValueError, match="missing columns: phone, state"):
        refresh_participants(spark.createDataFrame([("1",)], "id string"), None, AS_OF, CFG)
    spark.conf.set("spark.sql.session.timeZone", "America/Santiago")
    try:
        with pytest.raises(ValueError, match="timeZone"):
            refresh_participants(roster(spark, {}), None, AS_OF, CFG)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def contacts(spark, *rows):
    return spark.createDataFrame(
        [(i, "Sur", "Ana", None, "Rey", "Leo", "Paz", None, f"9{n}", s) for n, (i, s) in enumerate(rows)],
        "id string, school string, adult_name_1 string, adult_name_2 string, adult_name_3 string, "
        "child_name_1 string, child_name_2 string, child_name_3 string, phone string, contact_state string",
    )


def test_pending_contacts(spark):
    people = spark.createDataFrame([(1.0, "9", None), (12.0, "9", None)], "id double, phone string, state string")
    table = contacts(
        spark, (" 1.0", "participante"), ("2", " PARTICIPANTE "), ("2.0", "participante"), ("3", "otro"), (None, "participante")
    )
    rows = pending_contacts(table, people, CFG).collect()
    assert sorted(str(r.id) for r in rows) == ["2", "2", "None"]
    assert {(r.adult_name, r.child_name) for r in rows} == {("Ana Rey", "Leo Paz")}


def test_refresh_with_and_without_contacts(spark):
    people, logs = roster(spark, {}, {}), spark.createDataFrame([], LOG)
    processed, pending = refresh(people, contacts(spark, ("7", "participante")), logs, AS_OF, CFG)
    assert refresh_counts(processed, pending).first().asDict() == {"total_updated": 2, "pending_found": 1}
    assert refresh(people, None, logs, AS_OF, CFG)[1] is None

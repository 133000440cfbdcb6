"""DuckDB SQL for every registered query.

The texts state the contract a second time, in the other engine's terms: times
are read by format strings, one list per shape, and cells are compared in a
long table.
"""

from __future__ import annotations

import re

from checks.views import VIEWS, view_sql
from trailmark.config import (
    BADGES,
    COHORT_LABELS,
    NOISE_PATTERNS,
    REJECTION_WORDS,
    SCREEN_LABELS,
    SECTION_LABELS,
    STATUS_LABELS,
)
from trailmark.operators.schema import PARTICIPANT_TYPES

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
NUMBER = r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"


def values(pairs) -> str:
    rows = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in p) + ")" for p in pairs)
    return f"(VALUES {rows})"


def missing(c: str) -> str:
    return f"({c} IS NULL OR lower(trim({c})) IN ('', 'nat', 'nan', 'none'))"


def cleaned(c: str) -> str:
    return f"(CASE WHEN {missing(c)} THEN NULL ELSE {c} END)"


def _shapes() -> list[tuple[str, list[str]]]:
    y, d, f = r"\d{4}", r"\d{1,2}", r"\d{1,9}"
    h3, h2 = f"{d}:{d}:{d}", f"{d}:{d}"
    hms = "%H:%M:%S"
    shapes = [
        (f"{y}-{d}-{d}T{h3}[.]{f}", [f"%Y-%m-%dT{hms}.%f", f"%Y-%d-%mT{hms}.%f"]),
        (f"{y}-{d}-{d}T{h3}", [f"%Y-%m-%dT{hms}", f"%Y-%d-%mT{hms}"]),
        (f"{y}-{d}-{d} {h3}:{f}", [f"%Y-%m-%d {hms}:%f"]),
        (f"{y}-{d}-{d} {h3}", [f"%Y-%m-%d {hms}", f"%Y-%d-%m {hms}"]),
        (f"{y}-{d}-{d}", ["%Y-%m-%d", "%Y-%d-%m"]),
        (f"{y}-{d}-{d} {h3}[.]{f}", [f"%Y-%d-%m {hms}.%f", f"%Y-%m-%d {hms}.%f"]),
        (f"{y}-{d}-{d} {h2}", ["%Y-%d-%m %H:%M", "%Y-%m-%d %H:%M"]),
        (f"{y}-{d}-{d}T{h2}", ["%Y-%d-%mT%H:%M", "%Y-%m-%dT%H:%M"]),
        (f"{y}/{d}/{d} {h3}", [f"%Y/%d/%m {hms}", f"%Y/%m/%d {hms}"]),
        (f"{y}/{d}/{d}", ["%Y/%d/%m", "%Y/%m/%d"]),
        (f"{d}[.]{d}[.]{y}", ["%d.%m.%Y", "%m.%d.%Y"]),
        (r"\d{8}", ["%Y%m%d"]),
        (f"{y}-{d}", ["%Y-%m"]),
        (f"{d}/{y}", ["%m/%Y"]),
        (y, ["%Y"]),
    ]
    for s in "-/":
        shapes.append((f"{d}{s}{d}{s}{y} {h3}", [f"%d{s}%m{s}%Y {hms}", f"%m{s}%d{s}%Y {hms}"]))
        shapes.append((f"{d}{s}{d}{s}{y} {h2}", [f"%d{s}%m{s}%Y %H:%M", f"%m{s}%d{s}%Y %H:%M"]))
        shapes.append((f"{d}{s}{d}{s}{y}", [f"%d{s}%m{s}%Y", f"%m{s}%d{s}%Y"]))
    return shapes


def ts(c: str) -> str:
    """Time in a text, or NULL."""
    t = rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
    # A two-digit year is written out before the text is read.
    short = rf"regexp_replace({t}, '(..)$', '20\1')"
    cases = []
    for shape, formats in _shapes():
        tries = ", ".join(f"try_strptime({t}, '{f}')" for f in formats)
        cases.append(f"WHEN regexp_full_match({t}, '{shape}') THEN coalesce({tries})")
    for s in "-/":
        tries = f"try_strptime({short}, '%d{s}%m{s}%Y'), try_strptime({short}, '%m{s}%d{s}%Y')"
        cases.append(rf"WHEN regexp_full_match({t}, '\d{{1,2}}{s}\d{{1,2}}{s}\d{{2}}') THEN coalesce({tries})")
    body = "CASE " + " ".join(cases) + " END"
    return f"list_filter([{body}], lambda v: year(v) BETWEEN 1678 AND 2261)[1]"


def swapped(t: str) -> str:
    """Enrolment date with day and month put right."""
    swap = f"make_timestamp(year({t}), day({t}), month({t}), hour({t}), minute({t}), floor(second({t}))::DOUBLE)"
    return f"CASE WHEN day({t}) <= 12 THEN {swap} ELSE {t} END"


def floor_days(later: str, earlier: str) -> str:
    x = f"(epoch_us({later}) - epoch_us({earlier}))"
    day = 86400000000
    return f"CAST(({x} - (({x} % {day}) + {day}) % {day}) // {day} AS INTEGER)"


def digits(c: str) -> str:
    return f"regexp_replace(replace({c}, '.0', ''), '[^0-9]', '', 'g')"


def phone_key(c: str) -> str:
    return f"CASE WHEN length({digits(c)}) >= 9 THEN right({digits(c)}, 9) ELSE '' END"


def norm_id(c: str) -> str:
    return f"replace(trim({c}), '.0', '')"


def section(c: str) -> str:
    return f"CASE WHEN contains({c}, '_') THEN split_part({c}, '_', 1) ELSE left({c}, 6) END"


def step(c: str) -> str:
    names = ", ".join(f"'{s}'" for s in SECTION_LABELS)
    return f"coalesce(list_position([{names}], {section(c)}), 0)"


def progress(c: str) -> str:
    return f"({step(c)}::DOUBLE / {len(SECTION_LABELS)} * 100)"


def number(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '{NUMBER}') THEN try_cast(trim({c}) AS DOUBLE) END"


def int_days(c: str) -> str:
    t = f"trim({c})"
    time = r"\d{1,2}:\d{1,2}:\d{1,2}"
    stamp = (
        rf"CASE WHEN regexp_full_match({t}, '\d{{4}}-\d{{1,2}}-\d{{1,2}} {time}') THEN try_strptime({t}, '%Y-%m-%d %H:%M:%S')"
        rf" WHEN regexp_full_match({t}, '\d{{4}}-\d{{1,2}}-\d{{1,2}}') THEN try_strptime({t}, '%Y-%m-%d')"
        rf" WHEN regexp_full_match({t}, '\d{{1,2}}-\d{{1,2}}-\d{{4}} {time}') THEN try_strptime({t}, '%d-%m-%Y %H:%M:%S')"
        rf" WHEN regexp_full_match({t}, '\d{{1,2}}-\d{{1,2}}-\d{{4}}') THEN try_strptime({t}, '%d-%m-%Y') END"
    )
    return (
        f"CASE WHEN regexp_full_match({t}, '{NUMBER}') THEN try_cast(trunc(try_cast({t} AS DOUBLE)) AS INTEGER)"
        f" WHEN year({stamp}) = 1900 THEN CAST(date_diff('day', DATE '1899-12-30', CAST({stamp} AS DATE)) AS INTEGER) END"
    )


def differs(a: str, b: str) -> str:
    truth = "WHEN lower({c}) IN ('true', '1', '1.0') THEN 1 WHEN lower({c}) IN ('false', '0', '0.0') THEN 0"
    truths = [f"CASE {truth.format(c=c)} END" for c in (a, b)]
    plain = [f"replace(lower(trim({c})), '.0', '')" for c in (a, b)]
    instants = [f"date_trunc('second', {ts(c)})" for c in (a, b)]
    return f"""CASE WHEN {missing(a)} AND {missing(b)} THEN false
  WHEN {missing(a)} OR {missing(b)} THEN true
  WHEN coalesce({number(a)} = {number(b)}, false) THEN false
  WHEN coalesce({truths[0]} = {truths[1]}, false) THEN false
  ELSE coalesce({instants[0]} <> {instants[1]}, {plain[0]} <> {plain[1]}) END"""


def state_has(words) -> str:
    return "(" + " OR ".join(f"contains(word, '{w}')" for w in words) + ")"


def cell(c: str, kind: str) -> str:
    """Cell text of an export."""
    if kind == "timestamp_ntz":
        day, full = f"strftime({c}, '%Y-%m-%d')", f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
        return f"CASE WHEN strftime({c}, '%H:%M:%S') = '00:00:00' THEN {day} ELSE {full} END"
    if kind == "date":
        return f"strftime({c}, '%Y-%m-%d')"
    if kind == "string":
        return f"CASE WHEN {c} NOT IN ('NaT', 'nan') THEN {c} END"
    return c


def eval_text(due: str) -> str:
    return (
        f"CASE WHEN CAST({AS_OF} AS DATE) >= {due} THEN 'SÍ, DESDE EL ' ELSE 'NO, SE PODRÁ EL ' END"
        f" || strftime({due}, '%d/%m/%Y')"
    )


_NOISE = "|".join(NOISE_PATTERNS)
_LOOKUP = "CASE status " + " ".join(f"WHEN '{s}' THEN '{o}'" for s, o in STATUS_LABELS.items()) + " END"
_PROCESSED_COLUMNS = ", ".join(PARTICIPANT_TYPES)

_EXPORT_KINDS = {n: t for n, t in PARTICIPANT_TYPES.items() if n not in ("status_ordered", "first_log_text")}
_EXPORTED = {
    n: ("first_log" if n == "first_log_at" else "status_ordered" if n in ("status", "funnel_stage") else n)
    for n in _EXPORT_KINDS
}
_ORIGINAL_COLUMNS = (
    "id school adult_name adult_surname phone state enrolled_at first_log_at last_used_at days_since_use "
    "finished_at current_screen progress_pct completed comments"
).split()


def export_cell(name: str) -> str:
    if name == "completed":
        return "coalesce(completed, false) AS completed"
    if name == "first_log_at":
        return f"coalesce({cell('first_log_at', 'timestamp_ntz')}, first_log_text) AS first_log_at"
    return f"{cell(_EXPORTED[name], _EXPORT_KINDS[name])} AS {name}"


def diff_cell(name: str) -> str:
    if name == "completed":
        return "CAST(completed AS VARCHAR)"
    return f"CAST({export_cell(name).rsplit(' AS ', 1)[0]} AS VARCHAR)"


# Intermediate tables, each built on views and earlier ones.
CTES = {name: view_sql(name) for name in VIEWS} | {
    "visits": f"""
SELECT event_id, {phone_key("phone")} AS phone_key, {ts("entered_at")} AS visited_at, {cleaned("screen")} AS screen
FROM fx_logs WHERE NOT regexp_matches(coalesce(entry, ''), '{_NOISE}', 'i')""",
    "valid": "SELECT * FROM visits WHERE phone_key <> '' AND visited_at IS NOT NULL",
    "summary": f"""
SELECT phone_key, min(visited_at) AS first_log_at, max(visited_at) AS last_used_at,
       arg_max(screen, (visited_at, screen)) FILTER (screen IS NOT NULL) AS last_screen,
       arg_max(screen, (idx, visited_at, screen)) FILTER (idx > 0) AS furthest_screen,
       coalesce(arg_max(screen, (idx, visited_at, screen)) FILTER (idx > 0),
                arg_max(screen, (visited_at, screen)) FILTER (screen IS NOT NULL)) AS effective_screen,
       min(visited_at) FILTER (screen = 'L2B3S4_15') AS finished_at
FROM (SELECT *, {step("screen")} AS idx FROM valid) v GROUP BY phone_key""",
    "typed": f"""
SELECT row_no, id, school, adult_name, adult_surname, phone, state, {cleaned("enrolled_at")} AS enrolled_at,
       {cleaned("first_log_at")} AS first_log_text, {ts("first_log_at")} AS first_log_at,
       {ts("last_used_at")} AS last_used_at, {int_days("days_since_use")} AS days_since_use,
       {ts("finished_at")} AS finished_at, {cleaned("current_screen")} AS current_screen,
       {number("progress_pct")} AS progress_pct,
       CASE WHEN NOT {missing("completed")} THEN lower(completed) IN ('true', '1', '1.0') END AS completed,
       comments, {phone_key("phone")} AS phone_key
FROM fx_participants""",
    "joined": """
SELECT t.* EXCLUDE (first_log_text, first_log_at),
       coalesce(t.first_log_text, strftime(s.first_log_at, '%Y-%m-%d %H:%M:%S')) AS first_log_text,
       CASE WHEN t.first_log_text IS NOT NULL THEN t.first_log_at ELSE date_trunc('second', s.first_log_at) END AS first_log_at,
       s.phone_key IS NULL AND t.current_screen IS NULL AS unseen,
       s.last_used_at AS seen_last, s.effective_screen AS seen_screen, s.finished_at AS seen_finished
FROM typed t LEFT JOIN summary s ON t.phone_key = s.phone_key AND t.phone_key <> ''""",
    "kept": """
SELECT * EXCLUDE (first_log_text, first_log_at, last_used_at, days_since_use, current_screen, progress_pct),
       CASE WHEN NOT unseen THEN first_log_text END AS first_log_text,
       CASE WHEN NOT unseen THEN first_log_at END AS first_log_at,
       CASE WHEN NOT unseen THEN last_used_at END AS last_used_at,
       CASE WHEN NOT unseen THEN days_since_use END AS days_since_use,
       CASE WHEN NOT unseen THEN current_screen END AS current_screen,
       CASE WHEN unseen THEN 0.0::DOUBLE ELSE progress_pct END AS progress_pct
FROM joined""",
    "dated": f"""
SELECT *, first_log_at + INTERVAL 14 DAY AS expected_end_at, CAST(first_log_at AS DATE) AS first_log_date,
       {floor_days(AS_OF, "first_log_at")} AS days_elapsed,
       CAST(CAST(first_log_at AS DATE) + 28 AS DATE) AS week4_on, CAST(CAST(first_log_at AS DATE) + 42 AS DATE) AS week6_on,
       lower(trim(coalesce(state, ''))) AS word
FROM kept""",
    "resolved": f"""
SELECT * EXCLUDE (current_screen, progress_pct, last_used_at, days_since_use, completed, finished_at),
       coalesce(seen_screen, current_screen) AS current_screen,
       CASE WHEN seen_screen IS NOT NULL THEN date_trunc('second', seen_last) ELSE last_used_at END AS last_used_at,
       CASE WHEN seen_screen IS NOT NULL THEN {floor_days(AS_OF, "seen_last")} ELSE days_since_use END AS days_since_use,
       CASE WHEN done THEN true WHEN fake THEN false ELSE completed END AS completed,
       CASE WHEN done THEN 100.0::DOUBLE WHEN fake THEN 93.8::DOUBLE
            WHEN seen_screen IS NOT NULL THEN {progress("seen_screen")} ELSE progress_pct END AS progress_pct,
       CASE WHEN done THEN date_trunc('second', coalesce(seen_finished, {AS_OF})) WHEN fake THEN NULL ELSE finished_at END AS finished_at
FROM (SELECT *, (seen_finished IS NOT NULL OR coalesce(completed, false)) AND NOT {state_has(REJECTION_WORDS + ("error",))}
             AND NOT {state_has(("falso", "no completado"))} AS done,
             {state_has(("falso", "no completado"))} AS fake FROM dated) d""",
    "enrolled": f"""
SELECT * EXCLUDE (read_on), {swapped("read_on")} AS enrolled_on
FROM (SELECT *, {ts("enrolled_at")} AS read_on FROM resolved) r""",
    "processed": f"""
SELECT row_no, {_PROCESSED_COLUMNS}, enrolled_on
FROM (SELECT *, {_LOOKUP} AS status_ordered, NULL::VARCHAR AS funnel_stage,
             {eval_text("week4_on")} AS week4_eval, {eval_text("week6_on")} AS week6_eval
FROM (SELECT *, CASE
  WHEN contains(word, 'error') THEN 'Notificado con Error Técnico'
  WHEN {state_has(REJECTION_WORDS)} THEN 'Rechazo / Sin disponibilidad'
  WHEN first_log_text IS NULL AND {floor_days(AS_OF, "enrolled_on")} BETWEEN 0 AND 5 THEN 'Recién Notificado (< 5 días)'
  WHEN first_log_text IS NULL THEN 'Notificado - No Descarga App'
  WHEN completed THEN 'Completado'
  WHEN expected_end_at IS NULL THEN 'En Libro 1'
  WHEN {progress("current_screen")} >= 75 THEN 'En Progreso - Próximo a Terminar (Avanzado)'
  WHEN {progress("current_screen")} >= 50 THEN 'En Progreso - Empezando Libro 2'
  WHEN expected_end_at < {AS_OF} THEN 'En Progreso - Atrasado'
  ELSE 'En Libro 1' END AS status FROM enrolled) e) f""",
    "weeks": f"""
SELECT *, CASE WHEN weeks_enrolled IS NOT NULL THEN least(weeks_enrolled, 7) END AS bucket FROM (SELECT *, CASE WHEN enrolled_on IS NOT NULL THEN
  greatest(0, CAST(floor({floor_days(AS_OF, "enrolled_on")} / 7.0) AS INTEGER)) END AS weeks_enrolled FROM processed) p""",
    "records": """
SELECT row_no, replace(id, '.0', '') AS id, school, trim(concat_ws(' ', adult_name, adult_surname)) AS name, phone,
       strftime(enrolled_on, '%Y-%m-%d') AS enrolled_on, left(first_log_text, 10) AS first_log_on,
       strftime(expected_end_at, '%Y-%m-%d') AS expected_end_on, strftime(finished_at, '%Y-%m-%d') AS finished_on,
       current_screen, round_even(coalesce(progress_pct, 0.0)::DOUBLE, 1) AS progress, days_since_use, state,
       coalesce(completed, false) AS completed, status, weeks_enrolled, comments
FROM weeks""",
    "lists": """
SELECT *, CASE WHEN status = 'En Progreso - Atrasado' THEN 'late' WHEN status = 'Notificado - No Descarga App' THEN 'no_download'
  WHEN status IN ('Completado', 'En Progreso - Próximo a Terminar (Avanzado)') THEN 'confirm_completed' END AS call_list
FROM records""",
    "pending": f"""
SELECT {norm_id("id")} AS id, school, trim(concat_ws(' ', adult_name_1, adult_name_2, adult_name_3)) AS adult_name, phone,
       trim(concat_ws(' ', child_name_1, child_name_2, child_name_3)) AS child_name
FROM fx_contacts c WHERE lower(trim(contact_state)) = 'participante'
  AND NOT EXISTS (SELECT 1 FROM fx_participants p WHERE {norm_id("p.id")} = {norm_id("c.id")})""",
    "old_rows": f"""
SELECT * FROM fx_original QUALIFY row_number() OVER (PARTITION BY {norm_id("id")} ORDER BY row_no DESC) = 1""",
    "old_cells": "SELECT "
    + norm_id("id")
    + " AS match_id, unnest(["
    + ", ".join(f"{{'pos': {i}, 'name': '{c}', 'old': {c}}}" for i, c in enumerate(_ORIGINAL_COLUMNS))
    + "], recursive := true) FROM old_rows",
    "new_cells": "SELECT row_no, "
    + norm_id("id")
    + " AS match_id, unnest(["
    + ", ".join(f"{{'name': '{c}', 'new': {diff_cell(c)}}}" for c in _ORIGINAL_COLUMNS)
    + "], recursive := true) FROM processed",
    "cell_changes": f"""
SELECT row_no, string_agg(name, ',' ORDER BY pos) AS changed_columns
FROM (SELECT n.row_no, n.name, o.pos, {differs('n."new"', 'o."old"')} AS changed
      FROM new_cells n JOIN old_cells o ON n.match_id = o.match_id AND n.name = o.name) c
WHERE changed GROUP BY row_no""",
    "notes": f"""
SELECT {norm_id("id")} AS match_id, max(updated_at) AS updated_at, arg_max(comment, (updated_at, comment)) AS comment
FROM fx_comments GROUP BY 1""",
    "state_rows": """
SELECT *, 0 AS origin FROM fx_state_old UNION ALL SELECT *, 1 AS origin FROM fx_state_new""",
}

_PROCESSED = f"SELECT row_no, {_PROCESSED_COLUMNS} FROM processed"
_SUMMARY = "SELECT * FROM summary"
_ROSTER = """SELECT row_no + 4 AS row_no, id, school, adult_name, adult_surname, phone, state, enrolled_at, first_log_at,
  last_used_at, days_since_use, finished_at, current_screen, progress_pct, completed, comments FROM fx_participants"""
_UNPROCESSED = f"""SELECT row_no, id, school, phone, state, 'Desconocido' AS status, 'Desconocido' AS status_ordered,
  NULL::VARCHAR AS current_screen, 0.0::DOUBLE AS progress_pct, NULL::INTEGER AS days_since_use, false AS completed, '' AS comments,
  NULL::TIMESTAMP AS first_log_at, NULL::TIMESTAMP AS expected_end_at, NULL::TIMESTAMP AS finished_at FROM fx_participants"""
_COMMENTED = f"""SELECT row_no, id, coalesce(n.comment, p.comments) AS comments FROM
  (SELECT *, {norm_id("id")} AS match_id, row_number() OVER (PARTITION BY {norm_id("id")} ORDER BY row_no) AS rank FROM fx_participants) p
  LEFT JOIN notes n ON n.match_id = p.match_id AND p.rank = 1"""
_FUNNEL = values([(o, o[3:], i) for i, o in enumerate(sorted(STATUS_LABELS.values()))])
_SECTIONS = values([(s, label, i) for i, (s, label) in enumerate(SECTION_LABELS.items())])
_COHORTS = values([(i, label) for i, label in enumerate(COHORT_LABELS)])
_BADGE = "CASE " + " ".join(f"WHEN contains(status, '{w}') THEN '{n}'" for w, n in BADGES.items()) + " ELSE 'other' END"
_MILESTONES = f"""SELECT row_no, id, first_log_at, CAST(first_log_at AS DATE) AS first_log_date,
  first_log_at + INTERVAL 14 DAY AS expected_end_at, {floor_days(AS_OF, "first_log_at")} AS days_elapsed, week4_on, week6_on,
  {eval_text("week4_on")} AS week4_eval, {eval_text("week6_on")} AS week6_eval
  FROM (SELECT *, CAST(CAST(first_log_at AS DATE) + 28 AS DATE) AS week4_on, CAST(CAST(first_log_at AS DATE) + 42 AS DATE) AS week6_on FROM joined) j"""

QUERIES = {
    "roster_scan": _ROSTER,
    "contacts_scan": "SELECT row_no + 15 AS row_no, * EXCLUDE (row_no) FROM fx_contacts",
    "log_scan_range": "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-22'",
    "log_scan_text": f"""SELECT event_id, entered_at FROM (SELECT event_id, entered_at, {ts("entered_at")} AS t FROM fx_logs) x
WHERE t >= TIMESTAMP '2024-01-10' AND t < TIMESTAMP '2024-01-22'""",
    "snapshot_roundtrip": _PROCESSED,
    "snapshot_fallback": _UNPROCESSED.replace(" FROM fx_participants", ", NULL::TIMESTAMP AS last_sync_at FROM fx_participants"),
    "upsert_latest": """SELECT key, max(updated_at) AS updated_at, arg_max(content, (updated_at, origin, content)) AS content
FROM state_rows GROUP BY key""",
    "pii_roundtrip": """SELECT row_no, id, phone, adult_name, true AS wrong_key_fails,
  CAST(octet_length(encode(phone)) + 28 AS INTEGER) AS cipher_bytes FROM fx_participants""",
    "retain_versions": """SELECT event_id, CAST(ts AS DATE) AS version FROM events
WHERE CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) FROM events ORDER BY 1 DESC LIMIT 3)""",
    "export_rows": "SELECT row_no, " + ", ".join(export_cell(c) for c in _EXPORT_KINDS) + " FROM processed",
    "export_diff": "SELECT p.row_no, "
    + norm_id("p.id")
    + """ AS match_id, p.status_ordered AS status,
  CASE WHEN o.id IS NULL THEN 'new' WHEN c.row_no IS NULL THEN 'same' ELSE 'changed' END AS change_kind,
  coalesce(c.changed_columns, '') AS changed_columns
FROM processed p LEFT JOIN old_rows o ON """
    + f"{norm_id('p.id')} = {norm_id('o.id')} LEFT JOIN cell_changes c ON c.row_no = p.row_no",
    "ensure_schema": _UNPROCESSED,
    "null_normalise": f"""SELECT t.event_id, {cleaned("t.text")} AS text, {cleaned("n.text")} AS number,
  CASE WHEN {missing("n.text")} THEN NULL ELSE e.value END AS value
FROM fx_texts t JOIN fx_numbers n ON t.event_id = n.event_id JOIN events e ON e.event_id = t.event_id""",
    "phone_keys": f"""SELECT event_id, {phone_key("phone")} AS phone_key,
  CASE WHEN length({digits("phone")}) >= 9 THEN '56' || right({digits("phone")}, 9) ELSE {digits("phone")} END AS phone_e164 FROM fx_logs""",
    "id_normalise": f"""SELECT 'c' AS source, row_no, {norm_id("id")} AS id FROM fx_contacts
UNION ALL SELECT 'p', row_no, {norm_id("id")} FROM fx_participants""",
    "parse_timestamps": f"SELECT event_id, text, {ts('text')} AS parsed FROM fx_texts",
    "parse_enrolment": f"SELECT event_id, {swapped('t')} AS enrolled_on FROM (SELECT event_id, {ts('text')} AS t FROM fx_texts) x",
    "screen_progress": f"""SELECT event_id, screen, {section("screen")} AS section, CAST({step("screen")} - 1 AS INTEGER) AS section_index,
  {progress("screen")} AS progress_pct FROM fx_logs""",
    "elapsed_days": f"""SELECT event_id, {floor_days(AS_OF, "ts")} AS days_since, {floor_days("ts", AS_OF)} AS days_until FROM events""",
    "safe_numbers": f"""SELECT event_id, coalesce({number("text")}, 0.0) AS as_float, {int_days("text")} AS as_days,
  round_even(coalesce({number("text")}, 0.0) / 8, 1) AS rounded FROM fx_numbers""",
    "milestones": _MILESTONES,
    "cohort_weeks": "SELECT row_no, id, weeks_enrolled, bucket FROM weeks",
    "cohort_members": "SELECT row_no, id, weeks_enrolled, bucket FROM weeks WHERE bucket = 7",
    "records": "SELECT * EXCLUDE (row_no) FROM records",
    "completion": "SELECT row_no, id, completed, progress_pct, finished_at FROM processed",
    "funnel_status": "SELECT row_no, id, status, status_ordered FROM processed",
    "cell_differs": f"SELECT event_id, a, b, {differs('a', 'b')} AS differs FROM fx_pairs",
    "pending_contacts": "SELECT * FROM pending",
    "participant_card": f"""SELECT id, name, school, phone, status, {_BADGE} AS badge, current_screen, progress, first_log_on,
  expected_end_on, CASE WHEN first_log_on IS NOT NULL THEN coalesce(finished_on, first_log_on) ELSE 'Sin actividad' END AS last_active,
  days_since_use, comments FROM records""",
    "screen_labels": f"""SELECT event_id, screen, g.label AS screen_label FROM fx_logs
LEFT JOIN {values(SCREEN_LABELS.items())} AS g(code, label) ON g.code = screen""",
    "section_counts": f"""SELECT CAST(position AS INTEGER) AS position, g.section, label, coalesce(n, 0) AS n
FROM {_SECTIONS} AS g(section, label, position)
LEFT JOIN (SELECT {section("current_screen")} AS section, count(*) AS n FROM processed
           WHERE regexp_matches(status, 'En Progreso|Libro|Llamar') GROUP BY 1) c ON c.section = g.section""",
    "funnel_counts": f"""SELECT CAST(position AS INTEGER) AS position, g.stage, label, coalesce(n, 0) AS n
FROM {_FUNNEL} AS g(stage, label, position)
LEFT JOIN (SELECT status_ordered AS stage, count(*) AS n FROM processed GROUP BY 1) c ON c.stage = g.stage""",
    "log_noise_filter": f"SELECT event_id, phone, entered_at, screen, entry FROM fx_logs WHERE NOT regexp_matches(coalesce(entry, ''), '{_NOISE}', 'i')",
    "log_valid": "SELECT v.event_id, v.phone_key, v.visited_at, l.screen FROM valid v JOIN fx_logs l ON l.event_id = v.event_id",
    "log_summary": _SUMMARY,
    "call_lists": "SELECT * EXCLUDE (row_no) FROM lists WHERE call_list IS NOT NULL",
    "call_list_counts": """SELECT g.call_list, coalesce(n, 0) AS n
FROM (VALUES ('late'), ('no_download'), ('confirm_completed')) AS g(call_list)
LEFT JOIN (SELECT call_list, count(*) AS n FROM lists GROUP BY 1) c ON c.call_list = g.call_list""",
    "search_participants": """SELECT * EXCLUDE (row_no) FROM records
WHERE (contains(id, 'ana1') OR contains(lower(name), 'ana1') OR contains(coalesce(phone, ''), 'ana1'))
  AND school = 'BUILDING' AND status = 'Notificado - No Descarga App'""",
    "cohort_status": "SELECT bucket, status, count(*) AS n FROM weeks WHERE bucket IS NOT NULL GROUP BY ALL",
    "cohort_counts": f"""SELECT CAST(g.bucket AS INTEGER) AS bucket, label, coalesce(n, 0) AS n FROM {_COHORTS} AS g(bucket, label)
LEFT JOIN (SELECT bucket, count(*) AS n FROM weeks GROUP BY 1) c ON c.bucket = g.bucket""",
    "participant_activity": "SELECT row_no, id, first_log_text, first_log_at, first_log_date, week4_on, week6_on, week4_eval, "
    "week6_eval, last_used_at, days_since_use, days_elapsed, expected_end_at, current_screen, progress_pct FROM processed",
    "apply_comments": _COMMENTED,
    "unmatched_comments": f"""SELECT match_id, updated_at, comment FROM notes n
WHERE NOT EXISTS (SELECT 1 FROM fx_participants p WHERE {norm_id("p.id")} = n.match_id)""",
    "school_stats": """SELECT school, total, completed, total - completed AS pending,
  CASE WHEN total > 0 THEN round_even(completed / total * 100.0, 1) ELSE 0.0 END AS pct
FROM (SELECT school, count(id) AS total, count(*) FILTER (completed) AS completed FROM processed WHERE school IS NOT NULL GROUP BY school) s""",
    "kpis": """SELECT count(*) AS total, count(*) FILTER (completed) AS completed,
  count(*) FILTER (first_log_on IS NOT NULL AND NOT completed) AS active,
  count(*) FILTER (status = 'En Progreso - Atrasado') AS late FROM records""",
    "filter_values": """SELECT DISTINCT 'school' AS filter, school AS value FROM processed WHERE school <> ''
UNION ALL SELECT DISTINCT 'status', status FROM processed WHERE status <> ''""",
    "refresh_counts": "SELECT (SELECT count(*) FROM processed) AS total_updated, (SELECT count(*) FROM pending) AS pending_found",
    "refresh": _PROCESSED,
    "refresh_again": _PROCESSED,
    "stream_log_summary": _SUMMARY,
    "stream_refresh": _PROCESSED,
    "stream_comments": _COMMENTED,
}
QUERIES["export_written"] = QUERIES["export_diff"].replace("SELECT p.row_no,", "SELECT row_number() OVER (ORDER BY p.row_no) AS position, p.row_no,")
QUERIES["refresh_by_portions"] = _PROCESSED
QUERIES["stream_unmatched"] = QUERIES["unmatched_comments"]
QUERIES["kept_counts"] = f"""SELECT 'stage' AS measure, stage AS a, '' AS b, n FROM ({QUERIES["funnel_counts"]}) x
UNION ALL SELECT 'section', section, '', n FROM ({QUERIES["section_counts"]}) x
UNION ALL SELECT 'school total', school, '', total FROM ({QUERIES["school_stats"]}) x
UNION ALL SELECT 'school completed', school, '', completed FROM ({QUERIES["school_stats"]}) x
UNION ALL SELECT 'cohort', CAST(bucket AS VARCHAR), '', n FROM ({QUERIES["cohort_counts"]}) x
UNION ALL SELECT 'cohort status', CAST(bucket AS VARCHAR), status, n FROM ({QUERIES["cohort_status"]}) x
UNION ALL SELECT 'call list', call_list, '', n FROM ({QUERIES["call_list_counts"]}) x
UNION ALL SELECT 'filter', filter, value, 1 FROM ({QUERIES["filter_values"]}) x
UNION ALL SELECT 'all ' || name, '', '', n FROM (UNPIVOT ({QUERIES["kpis"]}) ON * INTO NAME name VALUE n) x"""


def _search(text: str) -> str:
    return f"""SELECT * EXCLUDE (row_no) FROM records
WHERE contains(id, '{text}') OR contains(lower(name), '{text}') OR contains(coalesce(phone, ''), '{text}')"""


QUERIES |= {f"search_indexed{name}": _search(text) for name, text in {"": "a12 soto1", "_many": "ana", "_short": "77"}.items()}
QUERIES["participant_card_of"] = QUERIES["participant_card"] + " WHERE id = (SELECT min(id) FROM records)"


def _with_needed(sql: str) -> str:
    """The text with the intermediate tables it needs in front, in order."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    if not needed:
        return sql
    once = {"visits", "typed", "joined", "resolved", "processed"}
    parts = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in once else ''}({CTES[n]})" for n in CTES if n in needed)
    return f"WITH {parts}\n{sql}"


def oracle_sql() -> dict[str, str]:
    """DuckDB text per registered query."""
    return {name: _with_needed(sql) for name, sql in QUERIES.items()}

"""Column expressions, case by case."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from trailmark.config import DEFAULT_CONFIG as CFG
from trailmark.functions import cells, numbers, screens, text, timestamps



@pytest.fixture(autouse=True, scope="module")
def the_column(spark):
    """A column can be named only once a session runs."""
    global C
    C = F.col("c")


def test_phone_key_and_e164(column):
    cases = {
        "+56 9 1234 5678": ("912345678", "56912345678"),
        "56912345678.0": ("912345678", "56912345678"),
        "912345678": ("912345678", "56912345678"),
        "(56) 9-1234-5678": ("912345678", "56912345678"),
        "1234567890123456": ("890123456", "56890123456"),
        "12345": ("", "12345"),
        "": ("", ""),
        "1..00": ("", "10"),
        "٣٣٣٣٣٣٣٣٣": ("", ""),
        None: ("", ""),
    }
    assert column(cases, text.phone_key(C)) == [k for k, _ in cases.values()]
    assert column(cases, text.last_nine(text.phone_digits(C))) == [k for k, _ in cases.values()]
    assert column(cases, text.phone_e164(C)) == [e for _, e in cases.values()]


def test_numeric_phone_is_not_written_with_an_exponent(spark):
    df = spark.createDataFrame([(56912345678.0,), (12.5,), (float("nan"),), (None,)], "phone double")
    assert [r[0] for r in df.select(text.text_of(df, "phone")).collect()] == ["56912345678", "12.5", None, None]


def test_normalise_id(column):
    assert column([" 12.0 ", "10.05", "A1", None], text.normalise_id(C)) == ["12", "105", "A1", None]


def test_missing_texts(column):
    texts = [None, "", "  ", "NaN", " nat ", "None", "nada", "0"]
    assert column(texts, text.null_if_missing(C)) == [None] * 6 + ["nada", "0"]
    assert column(texts, text.is_missing(C)) == [True] * 6 + [False, False]
    assert column([1.5, float("nan"), None], text.null_if_nan(C), "double") == [1.5, None, None]


def test_full_name_skips_missing_parts(spark):
    df = spark.createDataFrame([("Ana", None), (" Ana", "Soto "), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(text.full_name(F.col("a"), F.col("b"))).collect()] == ["Ana", "Ana Soto", ""]


TIMES = {
    "2024-05-07T10:11:12.123": "2024-05-07 10:11:12.123",
    "2024-05-07T10:11:12": "2024-05-07 10:11:12",
    "2024-05-07 10:11:12:250": "2024-05-07 10:11:12.25",
    "2024-25-07 10:11:12:250": None,
    "2024-05-07 10:11:12": "2024-05-07 10:11:12",
    "2024-13-07T10:11:12": "2024-07-13 10:11:12",
    "2024-5-7 1:2:3": "2024-05-07 01:02:03",
    "07-05-2024 10:11:12": "2024-05-07 10:11:12",
    "05-17-2024 10:11:12": "2024-05-17 10:11:12",
    "07/05/2024 10:11:12": "2024-05-07 10:11:12",
    "2024-05-07": "2024-05-07 00:00:00",
    "2024-25-07": "2024-07-25 00:00:00",
    "07-05-2024": "2024-05-07 00:00:00",
    "7/5/2024": "2024-05-07 00:00:00",
    "2024-05-07 10:11:12.123": "2024-07-05 10:11:12.123",
    "2024-05-17 10:11:12.123456789": "2024-05-17 10:11:12.123456",
    "2024-05-07 10:11": "2024-07-05 10:11:00",
    "2024-05-07T10:11": "2024-07-05 10:11:00",
    "07/05/2024 10:11": "2024-05-07 10:11:00",
    "07-05-24": "2024-05-07 00:00:00",
    "05/17/24": "2024-05-17 00:00:00",
    "2024/05/07 10:11:12": "2024-07-05 10:11:12",
    "2024/05/17": "2024-05-17 00:00:00",
    "07.05.2024": "2024-05-07 00:00:00",
    "20240507": "2024-05-07 00:00:00",
    "2024-05": "2024-05-01 00:00:00",
    "05/2024": "2024-05-01 00:00:00",
    "2024": "2024-01-01 00:00:00",
    "  2024-05-07   10:11:12 ": "2024-05-07 10:11:12",
    "2024-05-07\t10:11:12": "2024-05-07 10:11:12",
    " 2024-05-07  10:11:12:250 ": "2024-05-07 10:11:12.25",
    "07-05-2024   10:11:12": "2024-05-07 10:11:12",
    "07/05/2024\t10:11:12": "2024-05-07 10:11:12",
    "7/5/2024  9:05": "2024-05-07 09:05:00",
    "17-5-2024 10:11:12": "2024-05-17 10:11:12",
    "1-17-2024": "2024-01-17 00:00:00",
    "#07-05-2024": None,
    "07-05-2024x": None,
    "07-05-20245": None,
    "30-02-2024": None,
    "31/31/2024": None,
    "07-05/2024": None,
    "2024-05-07T10:11:12Z": None,
    "2024-05-07 10:11:12+02:00": None,
    "2024-05-07 24:00:00": None,
    "2024-05-07 10:60:00": None,
    "2024-05-07 10:11:60": None,
    "1677-12-31": None,
    "1678-01-01": "1678-01-01 00:00:00",
    "2261-12-31": "2261-12-31 00:00:00",
    "2262-01-01": None,
    "5": None,
    "nan": None,
    "": None,
    None: None,
}


def test_parse_ts(column):
    got = dict(zip(TIMES, column(TIMES, timestamps.parse_ts(C).cast("string")), strict=True))
    assert got == TIMES


def test_parse_ts_without_day_first_fallback(column):
    texts = ["2024-05-07 10:11:12.123", "2024-05-07 10:11", "2024/05/07", "07/05/2024"]
    got = column(texts, timestamps.parse_ts(C, dayfirst_fallback=False).cast("string"))
    assert [g[:10] for g in got] == ["2024-05-07"] * 4


def test_parse_ts_does_not_depend_on_the_session_zone(spark, column):
    spark.conf.set("spark.sql.session.timeZone", "America/Santiago")
    try:
        # Midnight does not exist there on this day.
        assert column(["2024-09-08 00:30:00"], timestamps.parse_ts(C)) == [datetime(2024, 9, 8, 0, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_enrolment_swaps_days_that_can_be_months(column):
    times = [datetime(2024, 5, 7, 1, 2, 3, 450000), datetime(2024, 5, 17, 1, 2, 3, 450000), None]
    got = column(times, timestamps.swap_day_month(C), "timestamp_ntz")
    assert got == [datetime(2024, 7, 5, 1, 2, 3), datetime(2024, 5, 17, 1, 2, 3, 450000), None]


@pytest.mark.parametrize("hours, days", [(0, 0), (1, -1), (-1, 0), (24, -1), (25, -2), (-47, 1), (-48, 2)])
def test_floor_days(column, hours, days):
    now = datetime(2024, 1, 31)
    then = now.timestamp() + hours * 3600
    at = datetime.fromtimestamp(then)
    assert column([at], timestamps.floor_days(F.lit(now).cast("timestamp_ntz"), C), "timestamp_ntz") == [days]


def test_weeks_since(column):
    now = F.lit(datetime(2024, 1, 31)).cast("timestamp_ntz")
    times = [datetime(2024, 1, 31), datetime(2024, 1, 24), datetime(2024, 1, 24, 1), datetime(2024, 3, 1), None]
    assert column(times, timestamps.weeks_since(now, C), "timestamp_ntz") == [0, 1, 0, 0, None]


def test_evaluable_text(column):
    now = F.lit(datetime(2024, 1, 31)).cast("timestamp_ntz")
    got = column([date(2024, 1, 31), date(2024, 2, 1)], timestamps.evaluable_text(now, C, CFG.evaluable_since, CFG.evaluable_from), "date")
    assert got == ["SÍ, DESDE EL 31/01/2024", "NO, SE PODRÁ EL 01/02/2024"]


def test_sections_and_progress(column):
    names = ["L1B2S1_3", "L2B3S4_15", "L1B3S4", "L1B1S0extra", "X9Z9", "L1", "", None]
    assert column(names, screens.section_of(C)) == ["L1B2S1", "L2B3S4", "L1B3S4", "L1B1S0", "X9Z9", "L1", "", None]
    assert column(names, screens.section_index(screens.section_of(C), CFG)) == [1, 15, 7, 0, -1, -1, -1, -1]
    assert column(names, screens.progress_pct(C, CFG)) == [12.5, 100.0, 50.0, 6.25, 0.0, 0.0, 0.0, 0.0]


def test_labels(column):
    assert column(["L1B1S0", "ZZ"], screens.section_label(C, CFG)) == ["L1 - Mapa misiones", "ZZ"]
    assert column(["2. Recién Notificados"], screens.funnel_label(C)) == ["Recién Notificados"]
    statuses = [
        "Completado",
        "En Progreso - Atrasado",
        "En Progreso - Próximo a Terminar (Avanzado)",
        "Notificado con Error Técnico",
        "Rechazo / Sin disponibilidad",
        "En Libro 1",
    ]
    assert column(statuses, screens.badge(C)) == ["completed", "late", "near_end", "error", "rejected", "other"]


def test_safe_numbers(column):
    texts = ["12", " 7.9 ", "-3.9", "1e3", "+4", ".5", "3.", "5d", "1_000", "inf", "nan", "", None, "abc"]
    floats = [12.0, 7.9, -3.9, 1000.0, 4.0, 0.5, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert column(texts, numbers.safe_float(C)) == floats
    days = [12, 7, -3, 1000, 4, 0, 3] + [None] * 7
    assert column(texts, numbers.safe_int_days(C)) == days


def test_days_shown_as_dates(column):
    texts = ["1900-01-05", "1900-01-05 00:00:00", "05-01-1900", "05-01-1900 10:00:00", "1900-02-30", "2024-01-05", "1e300"]
    assert column(texts, numbers.safe_int_days(C)) == [6, 6, 6, 6, None, None, None]
    assert column([datetime(1900, 1, 5), datetime(2024, 1, 5)], numbers.serial_days(C), "timestamp_ntz") == [6, None]


def test_round_half_even(column):
    assert column([6.25, 18.75, 93.8, 0.0], numbers.round1(C), "double") == [6.2, 18.8, 93.8, 0.0]


def test_completed_flag(column):
    texts = ["True", "TRUE", "1", "1.0", "False", "0", "yes", None]
    assert column(texts, numbers.completed_flag(C)) == [True] * 4 + [False] * 3 + [None]
    assert column(texts, numbers.to_completed(numbers.completed_flag(C))) == [True] * 4 + [False] * 4


PAIRS = [
    (None, "nan", False),
    ("", " NaT ", False),
    (None, "5", True),
    ("12.0", "12", False),
    ("1e2", "100", False),
    ("True", "1", False),
    ("False", "0.0", False),
    ("true", "false", True),
    ("0", "no", True),
    ("2024-01-20 09:00:00", "20-01-2024 09:00:00", False),
    ("2024-01-20T09:00:00.250", "2024-01-20 09:00:00", False),
    ("20/01/2024", "21/01/2024", True),
    ("2024", "2025", True),
    (" Hola ", "hola", False),
    ("casa.0", "CASA", False),
    ("1.05", "15", False),
    ("a", "b", True),
]


def test_differs_is_symmetric(spark):
    both = [(i, a, b) for i, (a, b, _) in enumerate(PAIRS)]
    df = spark.createDataFrame(both, "i int, a string, b string").coalesce(1)
    rows = df.select(
        "i", cells.differs(F.col("a"), F.col("b")).alias("x"), cells.differs(F.col("b"), F.col("a")).alias("y")
    )
    got = [(r.x, r.y) for r in rows.orderBy("i").collect()]
    assert got == [(e, e) for _, _, e in PAIRS]


def test_format_cell(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 2), date(2024, 1, 2), "NaT", 1.5), (datetime(2024, 1, 2, 3, 4, 5, 6), None, "x", None)],
        "t timestamp_ntz, d date, s string, n double",
    )
    rows = df.select(*[cells.format_cell(df, c).alias(c) for c in df.columns]).collect()
    assert [tuple(r) for r in rows] == [
        ("2024-01-02", "2024-01-02", None, 1.5),
        ("2024-01-02 03:04:05", None, "x", None),
    ]

"""Log filters and the summary per phone, against a plain loop."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest

from trailmark.config import DEFAULT_CONFIG as CFG
from trailmark.config import NOISE_PATTERNS
from trailmark.operators.logs import drop_noise, log_summary, valid_logs

SCHEMA = "phone string, entered_at string, screen string, entry string"
SCREENS = ["L1B1S0_15", "L1B2S1_3", "L1B3S1_33", "L2B3S4_14", "L2B3S4_15", "L1B3S4", "X9Z9_1", "OTHER", None]


def brute_force(rows):
    """First, last, last screen, furthest screen and first completion per phone."""
    seen = {}
    for phone, at, screen, entry in rows:
        if entry and any(re.search(p, entry, re.IGNORECASE) for p in NOISE_PATTERNS):
            continue
        key = re.sub("[^0-9]", "", phone)[-9:]
        if len(key) == 9 and at:
            seen.setdefault(key, []).append((datetime.strptime(at, "%Y-%m-%d %H:%M:%S"), screen))
    summary = {}
    for key, visits in seen.items():
        named = [(t, s) for t, s in visits if s]
        known = []
        for t, s in named:
            section = s.split("_")[0] if "_" in s else s[:6]
            if section in CFG.sections:
                known.append((CFG.sections.index(section), t, s))
        final = [t for t, s in named if s in CFG.final_screens]
        last = max(named)[1] if named else None
        furthest = max(known)[2] if known else None
        summary[key] = (
            min(t for t, _ in visits),
            max(t for t, _ in visits),
            last,
            furthest,
            furthest or last,
            min(final) if final else None,
        )
    return summary


def test_summary_equals_brute_force_with_a_hot_phone(spark):
    dice = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = []
    for _ in range(4000):
        user = 0 if dice.random() < 0.35 else dice.randrange(1, 120)
        at = start + timedelta(minutes=dice.randrange(60 * 24))
        phone = dice.choice(["+56 9{:08d}", "9{:08d}", "569-{:08d}"]).format(user)
        rows.append(
            (
                phone if dice.random() > 0.02 else "77",
                at.strftime("%Y-%m-%d %H:%M:%S") if dice.random() > 0.05 else None,
                dice.choice(SCREENS),
                dice.choice(["Uso", None, "Recordatorio AUTOMÁTICO", "system alert 3", "envio de notificación por inactividad"]),
            )
        )
    got = {r[0]: tuple(r)[1:] for r in log_summary(spark.createDataFrame(rows, SCHEMA).repartition(6), CFG).collect()}
    assert got == brute_force(rows)


def test_noise_filter_ignores_case_of_accents_and_keeps_null(spark):
    entries = ["ENVÍO DE NOTIFICACIÓN POR INACTIVIDAD", "Notificacion de inactividad", "x System Alert", "Uso", None]
    df = spark.createDataFrame([("9", "t", "s", e) for e in entries], SCHEMA)
    assert [r.entry for r in drop_noise(df, CFG).collect()] == ["Uso", None]


def test_logs_without_entry_column(spark):
    df = spark.createDataFrame([("911111111", "2024-01-01", "L1B1S0_15")], "phone string, entered_at string, screen string")
    assert drop_noise(df, CFG) is df
    assert log_summary(df, CFG).count() == 1


def test_typed_columns_are_accepted(spark):
    df = spark.createDataFrame(
        [(56911111111.0, datetime(2024, 1, 1, 5), "L1B1S0_15")], "phone double, entered_at timestamp_ntz, screen string"
    )
    row = log_summary(df, CFG).first()
    assert (row.phone_key, row.first_log_at) == ("911111111", datetime(2024, 1, 1, 5))


def test_invalid_rows(spark):
    df = spark.createDataFrame(
        [("911111111", "2024-01-01", "a", None), ("123", "2024-01-01", "a", None), ("911111111", "soon", "a", None)], SCHEMA
    )
    assert valid_logs(df, CFG).count() == 1
    assert log_summary(df.where("false"), CFG).count() == 0


def test_missing_log_columns_are_named(spark):
    with pytest.raises(ValueError, match="missing columns: phone, screen"):
        log_summary(spark.createDataFrame([("x",)], "entered_at string"), CFG)

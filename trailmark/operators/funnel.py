"""Funnel stage of a participant."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.config import ProgressConfig
from trailmark.functions.numbers import to_completed
from trailmark.functions.screens import lookup, progress_pct
from trailmark.functions.timestamps import floor_days, parse_ts, swap_day_month
from trailmark.operators.participants import clock, contains_any, operator_state

ENROLLED = "enrolled_on"


def with_enrolment(df: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """Add the enrolment instant, its day and month put right.

    The text is read by a function over an array, which keeps the generated
    code of the wide participant rows small enough to be compiled.
    """
    read = F.transform(F.array("enrolled_at"), lambda t: parse_ts(t, cfg.dayfirst_fallback))
    return df.withColumn(ENROLLED, F.get(read, F.lit(0))).withColumn(ENROLLED, swap_day_month(F.col(ENROLLED)))


def classify(df: DataFrame, as_of: datetime, cfg: ProgressConfig) -> DataFrame:
    """Add ``status`` and ``status_ordered``; the first rule that holds decides.

    Progress is taken from the screen, so a corrected false completion is placed
    by the screen it reached.
    """
    now = clock(as_of)
    state = operator_state(F.col("state"))
    names = cfg.statuses
    unused = F.col("first_log_text").isNull()
    due = F.col("expected_end_at")
    reached = F.when(due.isNotNull(), progress_pct(F.col("current_screen"), cfg))
    status = (
        F.when(contains_any(state, cfg.error_words), names.failed)
        .when(contains_any(state, cfg.rejection_words), names.rejected)
        .when(unused & floor_days(now, F.col(ENROLLED)).between(0, cfg.recent_days), names.recent)
        .when(unused, names.absent)
        .when(to_completed(F.col("completed")), names.done)
        .when(reached >= cfg.near_end_pct, names.near_end)
        .when(reached >= cfg.second_half_pct, names.second_half)
        .when(due < now, names.late)
        .otherwise(names.first_half)
    )
    return (
        with_enrolment(df, cfg)
        .withColumn("status", status)
        .withColumn("status_ordered", lookup(cfg.status_labels, F.col("status")))
        .drop(ENROLLED)
    )

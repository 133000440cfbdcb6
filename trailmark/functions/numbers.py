"""Tolerant numbers and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions.text import strip

# Decimal notation with an optional exponent, and nothing else.
NUMBER = r"^[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?$"

# The spellings of a date that a day count may be shown as, as
# (shape, rewrite to year-month-day order).
_SERIAL_SHAPES = (
    ("^1900-[0-9]{1,2}-[0-9]{1,2}(?: [0-9]{1,2}:[0-9]{1,2}:[0-5]?[0-9])?$", None),
    ("^[0-9]{1,2}-[0-9]{1,2}-1900(?: [0-9]{1,2}:[0-9]{1,2}:[0-5]?[0-9])?$", "$3-$2-$1"),
)
SERIAL_EPOCH = "1899-12-30"


def number_or_null(c: Column) -> Column:
    """Number in a text, or NULL."""
    text = strip(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def safe_float(c: Column, default: float = 0.0) -> Column:
    """Number in a text, or the default."""
    return F.coalesce(number_or_null(c), F.lit(default))


def serial_days(ts: Column) -> Column:
    """Days since the spreadsheet epoch of a date in 1900, NULL for other dates."""
    return F.when(F.year(ts) == 1900, F.date_diff(F.to_date(ts), F.lit(SERIAL_EPOCH).cast("date")))


def safe_int_days(c: Column) -> Column:
    """Whole days in a text: a number cut to an integer, or a day count shown as a date of 1900."""
    text = strip(c)
    (iso, _), (day_first, order) = _SERIAL_SHAPES
    stamp = F.when(text.rlike(iso), text.try_cast("timestamp_ntz")).when(
        text.rlike(day_first),
        F.regexp_replace(text, "^([0-9]{1,2})-([0-9]{1,2})-(1900)", order).try_cast("timestamp_ntz"),
    )
    return F.when(text.rlike(NUMBER), text.try_cast("double").try_cast("int")).otherwise(serial_days(stamp))


def round1(c: Column) -> Column:
    """One decimal, halves to the even digit."""
    return F.bround(c, 1)


def completed_flag(c: Column) -> Column:
    """Completion mark of a text: true, 1 and 1.0 (any case); NULL stays NULL."""
    return F.lower(c).isin("true", "1", "1.0")


def to_completed(c: Column) -> Column:
    """Completion mark with NULL taken as not completed."""
    return F.coalesce(c.cast("boolean"), F.lit(False))

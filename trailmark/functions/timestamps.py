"""Mixed-format timestamps, floor days and milestones.

A text is first recognised by its shape, then its date is put in year-month-day
order and the text is cast.  The cast needs no formatter and no session time zone and gives
NULL, not an error, for an impossible date.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"
DAY_MICROS = 86_400_000_000

# --- Fixed values: shapes of the accepted texts ------------------------------
# Blanks around the text and runs of blanks inside are accepted everywhere.
_Y = "(?:167[89]|16[89][0-9]|1[7-9][0-9]{2}|2[01][0-9]{2}|22[0-5][0-9]|226[01])"
_D = "[0-9]{1,2}"
_H2 = f"{_D}:{_D}"
_H3 = f"{_D}:{_D}:[0-5]?[0-9]"
_F = "[0-9]{1,9}"

# Year first, month next: ISO text with or without a time.
_ISO = rf"^\s*{_Y}-{_D}-{_D}(?:\s+{_H3}|T{_H3}(?:[.]{_F})?)?\s*$"
# Day first, with a four-digit year.
_DAY_FIRST = (
    rf"^\s*{_D}(?:-{_D}-{_Y}(?:\s+(?:{_H2}|{_H3}))?|/{_D}/{_Y}(?:\s+(?:{_H2}|{_H3}))?|[.]{_D}[.]{_Y})\s*$"
)
# Day first with equal separators and perhaps a time, in parts.
_DAY_FIRST_TEXT = rf"\s*({_D})([-/])({_D})\2({_Y})(\s+{_D}:{_D}(?::[0-5]?[0-9])?)?\s*$"
# ISO text with a colon before the fraction; no second reading.
_COLON_TEXT = rf"\s*({_Y}-{_D}-{_D})\s+({_H3}):({_F})\s*$"
# Year first, read loosely, so with the day before the month.
_LOOSE = rf"^\s*{_Y}(?:-{_D}-{_D}(?:\s+{_H3}[.]{_F}|(?:\s+|T){_H2})|/{_D}/{_D}(?:\s+{_H3})?)\s*$"
# Day first, with a two-digit year of this century.
_SHORT = rf"^\s*{_D}(?:-{_D}-|/{_D}/)[0-9]{{2}}\s*$"
# Digits only, or month and year only.
_COMPACT = rf"^\s*{_Y}[0-9]{{4}}\s*$"
_MONTH = rf"^\s*(?:{_Y}-{_D}|{_D}/{_Y}|{_Y})\s*$"
# --- End of the fixed values -------------------------------------------------

# Date parts of those shapes, up to the time of day.
_YEAR_FIRST_DATE = rf"^\s*({_Y})[-/]({_D})[-/]({_D})(?:T|\s*)"
_DAY_FIRST_DATE = rf"^\s*({_D})[-/.]({_D})[-/.]({_Y})\s*"
_SHORT_DATE = rf"^\s*({_D})[-/]({_D})[-/]([0-9]{{2}})\s*"


def _reading(c: Column, part: str, rewrite: str) -> Column:
    """Cast of a text with one part rewritten; NULL for an impossible date."""
    return F.regexp_replace(c, part, rewrite).try_cast(NTZ)


def parse_ts(c: Column, dayfirst_fallback: bool = True) -> Column:
    """Timestamp without time zone of a text in one of many spellings, or NULL.

    The shapes exclude each other, so their order is a matter of cost only.
    Where a date has two readings the second one is tried only if the first is
    impossible.  Two frequent shapes are rewritten without a test before: the
    text carries a mark that only their pattern takes away, and the cast
    refuses a marked text.
    """
    marked = F.concat(F.lit("#"), c)
    padded = F.when(F.substring(c, 3, 1).isin("-", "/"), _reading(marked, "#" + _DAY_FIRST_TEXT, "$4-$3-$1$5"))
    colon = _reading(marked, "#" + _COLON_TEXT, "$1 $2.$3")
    iso = F.coalesce(
        c.try_cast(NTZ),
        _reading(c, _YEAR_FIRST_DATE, "$1-$2-$3 "),
        _reading(c, _YEAR_FIRST_DATE, "$1-$3-$2 "),
    )
    day_first = F.coalesce(
        _reading(c, _DAY_FIRST_DATE, "$3-$2-$1 "), _reading(c, _DAY_FIRST_DATE, "$3-$1-$2 ")
    )
    month_first = _reading(c, _YEAR_FIRST_DATE, "$1-$2-$3 ")
    if dayfirst_fallback:
        loose = F.coalesce(_reading(c, _YEAR_FIRST_DATE, "$1-$3-$2 "), month_first)
    else:
        loose = month_first
    short = F.coalesce(_reading(c, _SHORT_DATE, "20$3-$2-$1"), _reading(c, _SHORT_DATE, "20$3-$1-$2"))
    rest = (
        F.when(c.rlike(_DAY_FIRST), day_first)
        .when(c.rlike(_LOOSE), loose)
        .when(c.rlike(_SHORT), short)
        .when(c.rlike(_COMPACT), _reading(c, r"^\s*(.{4})(..)(..)", "$1-$2-$3"))
        .when(c.rlike(_MONTH), _reading(c, rf"^\s*({_D})/({_Y})", "$2-$1"))
    )
    return F.coalesce(padded, F.when(c.rlike(_ISO), iso), colon, rest)


def swap_day_month(ts: Column) -> Column:
    """Enrolment date: day and month change places if the day can be a month.

    Such a date loses its fraction of a second; any other date stays as it is.
    """
    swapped = F.make_timestamp_ntz(
        F.year(ts), F.dayofmonth(ts), F.month(ts), F.hour(ts), F.minute(ts), F.second(ts)
    )
    return F.when(F.dayofmonth(ts) <= 12, swapped).otherwise(ts)


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, rounded towards minus infinity."""
    micros = F.timestamp_diff("MICROSECOND", earlier, later)
    return ((micros - F.pmod(micros, F.lit(DAY_MICROS))) / F.lit(DAY_MICROS)).cast("int")


def weeks_since(as_of: Column, enrolled: Column) -> Column:
    """Whole weeks since enrolment, never negative; NULL without a date."""
    days = floor_days(as_of, enrolled)
    weeks = ((days - F.pmod(days, F.lit(7))) / F.lit(7)).cast("int")
    return F.when(enrolled.isNotNull(), F.greatest(F.lit(0), weeks))


def plus_days(ts: Column, days: int) -> Column:
    """Timestamp some days later, the time of day kept."""
    return ts + F.make_dt_interval(F.lit(days))


def to_second(ts: Column) -> Column:
    """Timestamp without its fraction of a second."""
    return F.date_trunc("SECOND", ts).cast(NTZ)


def evaluable_text(as_of: Column, due: Column, since: str, later: str) -> Column:
    """Text saying since when, or from when on, a participant can be evaluated."""
    lead = F.when(F.to_date(as_of) >= due, F.lit(since)).otherwise(F.lit(later))
    return F.concat(lead, F.date_format(due, "dd/MM/yyyy"))

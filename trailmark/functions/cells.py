"""Comparing and formatting table cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.functions.numbers import number_or_null
from trailmark.functions.text import is_missing, strip
from trailmark.functions.timestamps import parse_ts, to_second

_TRUTH = {"true": True, "1": True, "1.0": True, "false": False, "0": False, "0.0": False}


def _truth(c: Column) -> Column:
    low = F.lower(c)
    yes = [k for k, v in _TRUTH.items() if v]
    no = [k for k, v in _TRUTH.items() if not v]
    return F.when(low.isin(*yes), F.lit(True)).when(low.isin(*no), F.lit(False))


def _plain(c: Column) -> Column:
    return F.replace(F.lower(strip(c)), F.lit(".0"), F.lit(""))


def canonical(c: Column) -> Column:
    """A form of a cell text, NULL for no value, such that cells of one form never differ.

    Case and blanks around a text change neither numbers and truth values nor the time a text is read as, as long as it
    is read at all.
    """
    return F.when(~is_missing(c), F.lower(strip(c)))


def may_be_time(c: Column) -> Column:
    """Whether a text can be a time: all spellings begin with a digit and have at least four characters."""
    return c.rlike(r"^\s*[0-9].{3}")


def differs(a: Column, b: Column, dayfirst_fallback: bool = True) -> Column:
    """Whether two cell texts really differ.

    Missing texts are equal to each other; then numbers, truth values, instants
    to the second and plain texts are compared, the first kind that applies.
    """
    same_number = F.coalesce(number_or_null(a) == number_or_null(b), F.lit(False))
    same_truth = F.coalesce(_truth(a) == _truth(b), F.lit(False))
    other_instant = F.when(
        may_be_time(a) & may_be_time(b), to_second(parse_ts(a, dayfirst_fallback)) != to_second(parse_ts(b, dayfirst_fallback))
    )
    no_a, no_b = is_missing(a), is_missing(b)
    return (
        F.when(a.eqNullSafe(b), F.lit(False))
        .when(no_a & no_b, F.lit(False))
        .when(no_a | no_b, F.lit(True))
        .when(same_number | same_truth, F.lit(False))
        .otherwise(F.coalesce(other_instant, _plain(a) != _plain(b)))
    )


def format_cell(df: DataFrame, name: str) -> Column:
    """Cell as it is handed out: times as text, missing texts as NULL, numbers as they are.

    A time at midnight shows its day only; a fraction of a second never shows.
    """
    c = F.col(name)
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        midnight = (F.hour(c) == 0) & (F.minute(c) == 0) & (F.second(c) == 0)
        day = F.date_format(c, "yyyy-MM-dd")
        return F.when(midnight, day).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, T.StringType):
        return F.when(~c.isin("NaT", "nan"), c)
    return c

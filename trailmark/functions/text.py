"""Text, phone and identifier cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.config import MISSING_TOKENS

_BLANKS = " \t\r\n"


def strip(c: Column) -> Column:
    """Text without leading and trailing white space."""
    return F.trim(c, F.lit(_BLANKS))


def is_missing(c: Column) -> Column:
    """True for NULL and for the texts that stand for no value."""
    return c.isNull() | F.lower(strip(c)).isin(*MISSING_TOKENS)


def null_if_missing(c: Column) -> Column:
    """NULL for the texts that stand for no value, the text itself otherwise."""
    return F.when(~F.lower(strip(c)).isin(*MISSING_TOKENS), c)


def null_if_nan(c: Column) -> Column:
    """NULL for NaN, the number itself otherwise."""
    return F.nanvl(c, F.lit(None).cast("double"))


def text_of(df: DataFrame, name: str) -> Column:
    """Column ``name`` as text.

    Whole floating-point numbers go through a decimal, so a phone read as
    56912345678.0 does not turn into exponent notation.
    """
    c = F.col(name)
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = c == F.floor(c)
        return F.when(whole, c.cast("decimal(38,0)").cast("string")).when(~F.isnan(c), c.cast("string"))
    return c.cast("string")


def phone_digits(c: Column) -> Column:
    """ASCII digits of a phone text, without the ``.0`` of numeric cells."""
    return F.regexp_replace(F.replace(c, F.lit(".0"), F.lit("")), "[^0-9]", "")


def last_nine(digits: Column) -> Column:
    """Last nine digits, or the empty text if there are fewer or none."""
    return F.when(F.length(digits) >= 9, F.right(digits, F.lit(9))).otherwise(F.lit(""))


def phone_key(c: Column) -> Column:
    """Key of a phone text."""
    return last_nine(phone_digits(c))


def with_phone_key(df: DataFrame, source: str, target: str = "phone_key") -> DataFrame:
    """Add the key of a phone column; the digits are a step of their own, so they are taken once per row."""
    return df.withColumn(target, phone_digits(text_of(df, source))).withColumn(target, last_nine(F.col(target)))


def phone_e164(c: Column, country: str = "56") -> Column:
    """Country code and last nine digits; shorter digit texts stay as they are."""
    digits = phone_digits(c)
    full = F.concat(F.lit(country), F.right(digits, F.lit(9)))
    return F.coalesce(F.when(F.length(digits) >= 9, full).otherwise(digits), F.lit(""))


def normalise_id(c: Column) -> Column:
    """Identifier without surrounding blanks and without any ``.0``."""
    return F.replace(strip(c), F.lit(".0"), F.lit(""))


def full_name(*parts: Column) -> Column:
    """Name parts joined by blanks; missing parts are left out."""
    return strip(F.concat_ws(" ", *parts))


def date_prefix(df: DataFrame, name: str) -> Column:
    """First ten characters of a text, or the day of a timestamp."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.when(c != "", F.left(c, F.lit(10)))
    return F.date_format(c, "yyyy-MM-dd")

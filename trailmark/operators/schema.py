"""Columns a table must have, and their types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.config import ProgressConfig
from trailmark.functions.numbers import completed_flag, number_or_null, safe_int_days, serial_days
from trailmark.functions.screens import lookup
from trailmark.functions.text import null_if_missing, null_if_nan, text_of
from trailmark.functions.timestamps import NTZ, parse_ts

# Processed participants: column -> type, in export order.
PARTICIPANT_TYPES = {
    "id": "string",
    "school": "string",
    "adult_name": "string",
    "adult_surname": "string",
    "phone": "string",
    "state": "string",
    "enrolled_at": "string",
    "first_log_text": "string",
    "first_log_at": NTZ,
    "first_log_date": "date",
    "week4_on": "date",
    "week6_on": "date",
    "week4_eval": "string",
    "week6_eval": "string",
    "last_used_at": NTZ,
    "days_since_use": "int",
    "days_elapsed": "int",
    "expected_end_at": NTZ,
    "finished_at": NTZ,
    "current_screen": "string",
    "progress_pct": "double",
    "completed": "boolean",
    "status": "string",
    "status_ordered": "string",
    "funnel_stage": "string",
    "comments": "string",
}

# Text columns in which the texts for "no value" mean no value.
_CLEANED = {"enrolled_at", "first_log_text", "current_screen"}

_TIMES = "_times"


def ensure_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add the columns that are missing, each with its default."""
    return df.withColumns({n: c for n, c in defaults.items() if n not in df.columns})


def ensure_schema(df: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """Add the columns the dashboard needs, with the values of an unprocessed roster."""
    null = F.lit(None)
    df = ensure_columns(df, {"status": F.lit(cfg.unknown)})
    ordered = F.coalesce(lookup(cfg.status_labels, F.col("status")), F.lit(cfg.unknown))
    return ensure_columns(
        df,
        {
            "status_ordered": ordered,
            "current_screen": null.cast("string"),
            "progress_pct": F.lit(0.0),
            "days_since_use": null.cast("int"),
            "completed": F.lit(False),
            "school": F.lit(cfg.unknown),
            "id": F.lit(""),
            "comments": F.lit(""),
            "first_log_at": null.cast(NTZ),
            "expected_end_at": null.cast(NTZ),
            "finished_at": null.cast(NTZ),
            "phone": null.cast("string"),
        },
    )


def _typed(df: DataFrame, name: str, target: str) -> Column:
    """Column ``name`` as ``target``, for everything but times written as text."""
    c, source = F.col(name), df.schema[name].dataType.simpleString()
    if target == "string":
        text = text_of(df, name)
        return null_if_missing(text) if name in _CLEANED else text
    if source == target:
        return null_if_nan(c) if target == "double" else c
    if target == "int":
        if source == "string":
            return safe_int_days(c)
        if source in (NTZ, "timestamp", "date"):
            return serial_days(c)
    if source == "string":
        return number_or_null(c) if target == "double" else completed_flag(null_if_missing(c))
    return c.try_cast(target)


def processed_types(df: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """Any roster, fresh or processed before, with the typed columns of a processed one.

    Columns that are missing are added without a value, cells that cannot be
    read become NULL, further columns stay.  The first use keeps its original
    text beside the timestamp, because a text that cannot be read still counts
    as a first use.
    """
    if "first_log_at" in df.columns and "first_log_text" not in df.columns:
        if df.schema["first_log_at"].dataType.simpleString() == "string":
            df = df.withColumnRenamed("first_log_at", "first_log_text")
        else:
            df = df.withColumn("first_log_text", F.date_format("first_log_at", "yyyy-MM-dd HH:mm:ss"))

    # Times written as text, by the column they are read into.  One function
    # over an array reads them all, so generated code does not grow with them.
    texts = {}
    for name, target in PARTICIPANT_TYPES.items():
        if target in (NTZ, "date"):
            source = name if name in df.columns else "first_log_text" if name == "first_log_at" else None
            if source in df.columns and df.schema[source].dataType.simpleString() == "string":
                texts[name] = F.col(source)
    if texts:
        read = F.transform(F.array(*texts.values()), lambda t: parse_ts(t, cfg.dayfirst_fallback))
        df = df.withColumn(_TIMES, read)

    places = {name: place for place, name in enumerate(texts)}
    columns = []
    for name, target in PARTICIPANT_TYPES.items():
        if name in places:
            value = F.get(_TIMES, F.lit(places[name])).cast(target)
        elif name in df.columns:
            value = _typed(df, name, target)
        else:
            value = F.lit(None).cast(target)
        columns.append(value.alias(name))
    extra = [c for c in df.columns if c not in PARTICIPANT_TYPES and c != _TIMES]
    return df.select(*columns, *extra)

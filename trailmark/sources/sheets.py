"""Sheet exports: header promotion, column names and input checks.

A sheet arrives as a table of texts with a ``row_no`` counted from 1, the way a
spreadsheet numbers its rows, because a distributed file has no row order.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.config import (
    CONTACT_POSITIONS,
    CONTACTS_SKIP,
    LOG_HEADERS,
    PARTICIPANT_HEADERS,
    ROSTER_SKIP,
)


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The table itself, or an error naming the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; found: {', '.join(df.columns)}")
    return df


def require_tables(spark, names: Iterable[str]) -> None:
    """An error naming the catalog tables that do not exist."""
    missing = [n for n in names if not spark.catalog.tableExists(n)]
    if missing:
        raise ValueError(f"missing tables: {', '.join(missing)}")


def promote_header(sheet: DataFrame, skip: int) -> DataFrame:
    """Use the row after the first ``skip`` rows as header and drop everything above it.

    Only that single row is fetched, to name the columns.  Cells without a
    header keep their position as name, as do repeated headers.
    """
    require_columns(sheet, ["row_no"])
    header = sheet.where(F.col("row_no") == skip + 1).first()
    if header is None:
        raise ValueError(f"the sheet has no row {skip + 1} to take the header from")
    taken = {"row_no"}
    columns = []
    for position, source in enumerate(c for c in sheet.columns if c != "row_no"):
        name = (header[source] or "").strip()
        if not name or name in taken:
            name = f"column_{position}"
        taken.add(name)
        columns.append(F.col(source).alias(name))
    return sheet.where(F.col("row_no") > skip + 1).select("row_no", *columns)


def rename_headers(df: DataFrame, headers: Mapping[str, str]) -> DataFrame:
    """Known headers replaced by the names used here; other columns stay."""
    return df.withColumnsRenamed({h: n for h, n in headers.items() if h in df.columns})


def read_roster(sheet: DataFrame, skip: int = ROSTER_SKIP) -> DataFrame:
    """Participants of a roster sheet; rows without a value in the first column are dropped."""
    table = promote_header(sheet, skip)
    first = next(c for c in table.columns if c != "row_no")
    return rename_headers(table.na.drop(subset=[first]), PARTICIPANT_HEADERS)


def read_contacts(sheet: DataFrame, skip: int = CONTACTS_SKIP) -> DataFrame:
    """Contacts of a contact sheet; the columns are known by position."""
    source = [c for c in require_columns(sheet, ["row_no"]).columns if c != "row_no"]
    if len(source) <= max(CONTACT_POSITIONS):
        raise ValueError(f"the contact sheet has {len(source)} columns, {max(CONTACT_POSITIONS) + 1} are needed")
    return sheet.where(F.col("row_no") > skip + 1).select(
        "row_no", *[F.col(source[p]).alias(n) for p, n in CONTACT_POSITIONS.items()]
    )


def read_logs(report: DataFrame) -> DataFrame:
    """Log report with the column names used here."""
    return require_columns(rename_headers(report, LOG_HEADERS), ["phone", "entered_at", "screen"])

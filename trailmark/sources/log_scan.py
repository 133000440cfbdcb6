"""Date-bounded scan of a log table."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.config import ProgressConfig
from trailmark.functions.timestamps import NTZ, parse_ts


def scan_logs(
    logs: DataFrame,
    date_from: date,
    as_of: datetime,
    cfg: ProgressConfig,
    time_column: str = "entered_at",
    date_column: str | None = None,
) -> DataFrame:
    """Log rows from ``date_from`` to the end of the day of ``as_of``.

    Both bounds are literals, so on a typed column they reach the file scan.
    ``date_column`` names the day partitions of the table, if it has some, and
    prunes them.
    """
    until = as_of.date() + timedelta(days=1)
    at = F.col(time_column)
    if logs.schema[time_column].dataType.typeName() == "string":
        at = parse_ts(at, cfg.dayfirst_fallback)
    rows = logs
    if date_column is not None:
        rows = rows.where((F.col(date_column) >= F.lit(date_from)) & (F.col(date_column) < F.lit(until)))
    low = F.lit(datetime.combine(date_from, datetime.min.time())).cast(NTZ)
    high = F.lit(datetime.combine(until, datetime.min.time())).cast(NTZ)
    return rows.where((at >= low) & (at < high))

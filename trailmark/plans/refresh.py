"""Refresh: logs, roster and contacts in, processed participants and pending contacts out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from trailmark.config import DEFAULT_CONFIG, ProgressConfig
from trailmark.operators.funnel import classify
from trailmark.operators.logs import log_summary
from trailmark.operators.participants import participant_activity
from trailmark.operators.pending import pending_contacts
from trailmark.operators.schema import processed_types
from trailmark.sources.sheets import require_columns


def require_utc(df: DataFrame) -> None:
    """Timestamps are wall-clock times; a session zone with gaps would move some of them."""
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z", "+00:00", "GMT"):
        raise ValueError(f"set spark.sql.session.timeZone to UTC (it is {zone})")


def refresh_participants(
    participants: DataFrame, summary: DataFrame, as_of: datetime, cfg: ProgressConfig = DEFAULT_CONFIG
) -> DataFrame:
    """Participants brought up to date with a log summary."""
    require_utc(participants)
    require_columns(participants, ["id", "phone", "state"])
    typed = processed_types(participants, cfg)
    return classify(participant_activity(typed, summary, as_of, cfg), as_of, cfg)


def refresh(
    participants: DataFrame,
    contacts: DataFrame | None,
    logs: DataFrame,
    as_of: datetime,
    cfg: ProgressConfig = DEFAULT_CONFIG,
) -> tuple[DataFrame, DataFrame | None]:
    """Processed participants and the contacts that may be added to the roster.

    The result can be the input of the next refresh: a first use once found
    stays, everything else follows the logs.
    """
    processed = refresh_participants(participants, log_summary(logs, cfg), as_of, cfg)
    pending = None if contacts is None else pending_contacts(contacts, participants, cfg)
    return processed, pending

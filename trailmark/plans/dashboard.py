"""Everything the dashboard shows, from one table of processed participants."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from trailmark.config import DEFAULT_CONFIG, ProgressConfig
from trailmark.operators import dashboard, tallies


def dashboard_tables(
    participants: DataFrame,
    as_of: datetime,
    cfg: ProgressConfig = DEFAULT_CONFIG,
    pending: DataFrame | None = None,
    last_sync_at: datetime | None = None,
    kept: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """One table per part of the dashboard; the pending contacts are among them if they are given.

    Meant for a stored table (see :class:`trailmark.plans.tracker.Tracker`):
    every part is a query of its own and reads only the columns it needs.
    Where a store keeps tallies, ``kept``, the counts come from these.
    """
    df = dashboard.dashboard_input(participants, cfg)
    rows = dashboard.records(df, as_of, cfg)
    sync = participants.sparkSession.createDataFrame([(last_sync_at,)], "last_sync_at timestamp_ntz")
    counts, source = (dashboard, df) if kept is None else (tallies, kept)
    return ({} if pending is None else {"pending": pending}) | {
        "last_sync": sync,
        "records": rows,
        "kpis": counts.kpis(source, cfg),
        "funnel": counts.funnel_counts(source, cfg),
        "sections": counts.section_counts(source, cfg),
        "schools": counts.school_stats(source),
        "cohorts": counts.cohort_counts(source, as_of, cfg),
        "cohort_status": counts.cohort_status(source, as_of, cfg),
        "call_lists": dashboard.call_lists(rows, cfg),
        "call_list_counts": counts.call_list_counts(source, cfg),
        "filter_values": counts.filter_values(source),
        "cards": dashboard.cards(rows, cfg),
    }

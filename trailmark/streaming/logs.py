"""Log summary kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trailmark.config import ProgressConfig
from trailmark.operators.logs import VISITS, merge_visits, screen_visits, summarise
from trailmark.streaming.store import LevelledTable, start


def visits_table(spark: SparkSession, folder: str) -> LevelledTable:
    """First and last visits per phone and screen, as a stream leaves them."""
    return LevelledTable(spark, folder, VISITS, merge_visits)


def stream_visits(logs: DataFrame, folder: str, checkpoint: str, cfg: ProgressConfig, **trigger) -> StreamingQuery:
    """Reduce every batch to first and last visits per phone and screen and add them to a levelled table.

    The stream itself has no state: visits merge, in the table and when it is read.
    """
    table = visits_table(logs.sparkSession, folder)
    return start(logs, lambda rows, batch_id: table.add(screen_visits(rows, cfg), batch_id), checkpoint, "append", **trigger)


def streamed_summary(spark: SparkSession, folder: str, cfg: ProgressConfig) -> DataFrame:
    """Log summary of everything the stream has written; empty before the first batch."""
    return summarise(merge_visits(visits_table(spark, folder).read()), cfg)

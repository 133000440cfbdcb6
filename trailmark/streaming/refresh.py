"""Participants refreshed with every micro-batch of logs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from trailmark.config import ProgressConfig
from trailmark.plans.live import fold_logs
from trailmark.sources.snapshots import SnapshotStore
from trailmark.streaming.store import start, stream_id


def stream_refresh(
    logs: DataFrame,
    participants: DataFrame,
    snapshots: SnapshotStore,
    checkpoint: str,
    clock: Callable[[], datetime],
    cfg: ProgressConfig,
    buckets: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Every batch becomes a portion of logs in the newest version of a store, see :func:`fold_logs`.

    An empty store starts from the given participants, any other from what it has, so an upload, a refresh or comments
    in between are kept.  A batch and the tables it changed are one version that names the batch: a batch that runs
    again after its version was made changes nothing.  Old versions expire.
    """

    def on_batch(rows: DataFrame, batch_id: int) -> None:
        mark = (f"refresh {stream_id(snapshots.spark, checkpoint)}", batch_id)
        fold_logs(snapshots, rows, clock(), f"batch {batch_id}", cfg, participants, buckets, mark)

    return start(logs, on_batch, checkpoint, "append", **trigger)

"""Comments arriving as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from trailmark.config import DEFAULT_CONFIG, ProgressConfig
from trailmark.operators.comments import latest_comments
from trailmark.plans.commenting import comment
from trailmark.sources.snapshots import Change, SnapshotStore
from trailmark.streaming.store import start, stream_id

COMMENTS = "id string, comment string, updated_at timestamp_ntz"


def stream_comments(comments: DataFrame, snapshots: SnapshotStore, checkpoint: str, cfg: ProgressConfig = DEFAULT_CONFIG, **trigger) -> StreamingQuery:
    """Write comments into the newest version of a store as they arrive.

    The newest comment per id is the state, so one that comes late does not take the place of a newer one.  Every batch
    is a version that names it: a batch that runs again changes nothing.  Ids that no participant has are in the table
    ``unmatched`` of the newest version.
    """
    newest = latest_comments(comments).withColumnRenamed("match_id", "id")

    def on_batch(rows: DataFrame, batch_id: int) -> None:
        name = f"comments {stream_id(snapshots.spark, checkpoint)}"

        def build(change: Change) -> bool | None:
            if change.base is None:
                raise ValueError("upload a roster first")
            if int(change.marks.get(name, -1)) >= batch_id:
                return False
            change.marks[name] = str(batch_id)
            comment(change, rows)
            return None

        rows.persist()
        try:
            snapshots.update(f"comments {batch_id}", build, keep_sync=True)
        finally:
            rows.unpersist()
        snapshots.expire(cfg.retained_versions)

    return start(newest, on_batch, checkpoint, "update", **trigger)

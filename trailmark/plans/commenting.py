"""Comments written into the versions of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators.comments import comment_targets, unmatched_comments, with_targets
from trailmark.operators.schema import ensure_columns
from trailmark.sources.snapshots import BUCKET, Change
from trailmark.sources.workdir import stored


def _in_place(change: Change, name: str, comments: DataFrame) -> None:
    """Write comments into a table of participants; of a table in buckets only those with commented rows are rewritten."""
    column = {"comments": F.lit(None).cast("string")}
    if not change.in_buckets(name):
        rows = ensure_columns(change.table(name), column)
        change.put(name, with_targets(rows, comment_targets(rows, comments)))
        return
    rows = change.part(name)
    targets = stored(comment_targets(rows, comments), "comments")
    hit = rows.select("row_no", BUCKET).join(targets.select("row_no"), "row_no", "left_semi")
    buckets = [r[0] for r in hit.select(BUCKET).distinct().collect()]  # no more than there are
    if buckets:
        change.put(name, with_targets(ensure_columns(change.part(name, buckets), column), targets), buckets)


def comment(change: Change, comments: DataFrame) -> None:
    """Write the newest comment of each id to the first participant that has it, in all a version keeps of them.

    These are the processed participants and the roster that portions of logs start from; the uploaded one stays as it
    was.  Comments whose id no participant has are kept in the table ``unmatched``, the newest of each id.
    """
    change.drop("postings", "search_rows")
    for name in ("processed", "roster"):
        if name in change.folders:
            _in_place(change, name, comments)
    waiting = comments.select("id", "updated_at", "comment")
    if "unmatched" in change.folders:
        waiting = waiting.unionByName(change.table("unmatched").withColumnRenamed("match_id", "id"))
    change.put("unmatched", unmatched_comments(change.table("processed"), waiting))

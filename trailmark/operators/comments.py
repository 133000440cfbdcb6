"""Comments written by operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.text import normalise_id, text_of


def latest_comments(comments: DataFrame) -> DataFrame:
    """Newest comment per normalised id; equal times are settled by the text."""
    newest = F.max(F.struct("updated_at", "comment"))
    return (
        comments.groupBy(normalise_id(text_of(comments, "id")).alias("match_id"))
        .agg(newest.alias("newest"))
        .select("match_id", "newest.updated_at", "newest.comment")
    )


def comment_targets(participants: DataFrame, comments: DataFrame, order_by: str = "row_no") -> DataFrame:
    """(match_id, ``order_by``, comment): the newest comment of an id and the first row that has the id.

    Only rows of commented ids are grouped to find the first of each.
    """
    newest = latest_comments(comments)
    rows = participants.select(normalise_id(text_of(participants, "id")).alias("match_id"), order_by)
    rows = rows.join(newest.select("match_id"), "match_id", "left_semi")
    first = rows.groupBy("match_id").agg(F.min(order_by).alias(order_by))
    return newest.join(first, "match_id").select("match_id", order_by, "comment")


def with_targets(participants: DataFrame, targets: DataFrame, order_by: str = "row_no") -> DataFrame:
    """Participants with the comments of ``comment_targets``.

    The wide join is on a unique pair, so a frequent id does no harm.
    """
    match = normalise_id(text_of(participants, "id"))
    return (
        participants.withColumn("match_id", match)
        .join(targets, ["match_id", order_by], "left")
        .withColumn("comments", F.coalesce("comment", "comments"))
        .select(*participants.columns)
    )


def apply_comments(participants: DataFrame, comments: DataFrame, order_by: str = "row_no") -> DataFrame:
    """Participants with the newest comment on the first row of each id."""
    return with_targets(participants, comment_targets(participants, comments, order_by), order_by)


def unmatched_comments(participants: DataFrame, comments: DataFrame) -> DataFrame:
    """Newest comments whose id is on no participant."""
    known = participants.select(normalise_id(text_of(participants, "id")).alias("match_id")).distinct()
    return latest_comments(comments).join(known, "match_id", "left_anti")

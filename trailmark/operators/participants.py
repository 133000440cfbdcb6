"""Participant activity, milestones and completion.

Each step is a function of the columns the step before it left: activity join,
reset, milestones, activity update, completion.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.config import ProgressConfig
from trailmark.functions.numbers import to_completed
from trailmark.functions.screens import progress_pct
from trailmark.functions.text import strip, with_phone_key
from trailmark.functions.timestamps import NTZ, evaluable_text, floor_days, plus_days, to_second
from trailmark.operators.joins import join_by_key

# Columns of the log summary beside a participant's own, until the last step.
_SEEN = {
    "first_log_at": "seen_first_at",
    "last_used_at": "seen_last_at",
    "effective_screen": "seen_screen",
    "finished_at": "seen_finished_at",
}

_RESET = [
    "first_log_text",
    "first_log_at",
    "first_log_date",
    "week4_on",
    "week6_on",
    "week4_eval",
    "week6_eval",
    "last_used_at",
    "days_since_use",
    "days_elapsed",
    "expected_end_at",
    "current_screen",
]


def clock(as_of: datetime) -> Column:
    """The explicit now of a run."""
    return F.lit(as_of).cast(NTZ)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text contains one of the words."""
    return text.rlike("|".join(re.escape(word) for word in words))


def operator_state(c: Column) -> Column:
    """Operator's state for word tests: trimmed, lower case, never NULL."""
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def join_activity(participants: DataFrame, summary: DataFrame) -> DataFrame:
    """Participants with the summary of their phone; a phone without nine digits matches nothing."""
    seen = summary.select("phone_key", *[F.col(c).alias(n) for c, n in _SEEN.items()])
    keyed = with_phone_key(participants, "phone").withColumn("phone_key", F.nullif("phone_key", F.lit("")))
    return join_by_key(keyed, seen, "phone_key", "left").drop("phone_key")


def fill_first_log(df: DataFrame) -> DataFrame:
    """First use from the logs where the roster has none; an existing one stays."""
    known = F.col("first_log_text").isNotNull()
    seen = to_second(F.col("seen_first_at"))
    return df.withColumns(
        {
            "first_log_at": F.when(known, F.col("first_log_at")).otherwise(seen),
            "first_log_text": F.coalesce(
                F.col("first_log_text"), F.date_format("seen_first_at", "yyyy-MM-dd HH:mm:ss")
            ),
        }
    )


def reset_unseen(df: DataFrame) -> DataFrame:
    """Forget the activity of participants with neither logs nor a roster screen."""
    unseen = F.col("seen_last_at").isNull() & F.col("current_screen").isNull()
    columns = {c: F.when(~unseen, F.col(c)) for c in _RESET}
    columns["progress_pct"] = F.when(unseen, F.lit(0.0)).otherwise(F.col("progress_pct"))
    return df.withColumns(columns)


def milestones(df: DataFrame, as_of: datetime, cfg: ProgressConfig) -> DataFrame:
    """Expected end, elapsed days and evaluation dates where the first use is known."""
    now, first = clock(as_of), F.col("first_log_at")
    day = F.to_date(first)
    week4, week6 = F.date_add(day, cfg.week4_days), F.date_add(day, cfg.week6_days)
    derived = {
        "expected_end_at": plus_days(first, cfg.expected_days),
        "days_elapsed": floor_days(now, first),
        "first_log_date": day,
        "week4_on": week4,
        "week6_on": week6,
        "week4_eval": evaluable_text(now, week4, cfg.evaluable_since, cfg.evaluable_from),
        "week6_eval": evaluable_text(now, week6, cfg.evaluable_since, cfg.evaluable_from),
    }
    return df.withColumns({c: F.when(first.isNotNull(), v).otherwise(F.col(c)) for c, v in derived.items()})


def update_activity(df: DataFrame, as_of: datetime, cfg: ProgressConfig) -> DataFrame:
    """Screen, progress and last use from the logs; without a screen the old values stay."""
    screen, last = F.col("seen_screen"), F.col("seen_last_at")
    fresh = {
        "current_screen": screen,
        "progress_pct": progress_pct(screen, cfg),
        "last_used_at": to_second(last),
        "days_since_use": floor_days(clock(as_of), last),
    }
    return df.withColumns({c: F.when(screen.isNotNull(), v).otherwise(F.col(c)) for c, v in fresh.items()})


def resolve_completion(df: DataFrame, as_of: datetime, cfg: ProgressConfig) -> DataFrame:
    """Completion, its date and its progress, as the operator's state allows."""
    state = operator_state(F.col("state"))
    reached = F.col("seen_finished_at").isNotNull() | to_completed(F.col("completed"))
    refused = contains_any(state, cfg.rejection_words + cfg.error_words + cfg.false_completion_words)
    finish = to_second(F.coalesce(F.col("seen_finished_at"), clock(as_of)))
    done, undone = F.col("_done"), F.col("_undone")
    return (
        df.withColumns({"_done": reached & ~refused, "_undone": contains_any(state, cfg.false_completion_words)})
        .withColumns(
            {
                "completed": F.when(done, True).when(undone, False).otherwise(F.col("completed")),
                "progress_pct": F.when(done, 100.0)
                .when(undone, cfg.false_completion_pct)
                .otherwise(F.col("progress_pct")),
                "finished_at": F.when(done, finish).when(~undone, F.col("finished_at")),
            }
        )
        .drop("_done", "_undone")
    )


def participant_activity(
    participants: DataFrame, summary: DataFrame, as_of: datetime, cfg: ProgressConfig
) -> DataFrame:
    """All steps on typed participants, without the funnel stage."""
    df = fill_first_log(join_activity(participants, summary))
    df = update_activity(milestones(reset_unseen(df), as_of, cfg), as_of, cfg)
    return resolve_completion(df, as_of, cfg).drop(*_SEEN.values())

"""Counts of the dashboard kept by differences.

A tally is one small table of (measure, group, time, count) from which every count of the dashboard follows.  A change
of some participants adds what they count now and takes off what they counted before; all others are not looked at.
Cohorts depend on the day they are asked for, so they are kept by the time of enrolment and put into weeks when read.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.config import ProgressConfig
from trailmark.functions.numbers import round1, to_completed
from trailmark.functions.screens import funnel_label, section_label, section_of
from trailmark.functions.timestamps import weeks_since
from trailmark.operators.dashboard import call_list
from trailmark.operators.funnel import ENROLLED, with_enrolment
from trailmark.operators.participants import clock

TALLY = "measure string, a string, at timestamp_ntz, n bigint"


def tally(participants: DataFrame, cfg: ProgressConfig, sign: int = 1) -> DataFrame:
    """What processed participants count, or with ``sign`` -1 what goes when they go; one row a group.

    There are as many rows as stages, sections, statuses, schools, and pairs of status and time of enrolment.
    """
    done = to_completed(F.col("completed"))
    used = F.col("first_log_text").isNotNull()
    active = F.col("status").rlike(cfg.active_status_pattern)
    cohort = F.when(F.col(ENROLLED).isNotNull(), F.coalesce(F.nullif("status", F.lit("")), F.lit(cfg.unknown)))

    def one(measure: str, group: Column, counts: Column | None = None, at: Column | None = None) -> Column:
        n = F.lit(sign) if counts is None else F.when(counts, sign).otherwise(0)
        time = F.lit(None).cast("timestamp_ntz") if at is None else at
        return F.struct(F.lit(measure).alias("measure"), group.alias("a"), time.alias("at"), n.cast("bigint").alias("n"))

    counted = F.array(
        one("stage", F.col("status_ordered")),
        one("section", F.when(active, section_of(F.col("current_screen")))),
        one("status", F.col("status")),
        one("school", F.col("school")),
        one("school id", F.col("school"), F.col("id").isNotNull()),
        one("school done", F.col("school"), done),
        one("all", F.lit("total")),
        one("all", F.lit("completed"), done),
        one("all", F.lit("active"), used & ~done),
        one("cohort", cohort, at=F.col(ENROLLED)),
    )
    return merged(with_enrolment(participants, cfg).select(F.inline(counted)).where("a is not null and n <> 0"))


def merged(tallies: DataFrame) -> DataFrame:
    """Tallies and differences put together; groups nobody is in any more go."""
    return tallies.groupBy("measure", "a", "at").agg(F.sum("n").alias("n")).where("n <> 0")


def difference(before: DataFrame, after: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """What a change of these participants adds to a tally."""
    return merged(tally(before, cfg, -1).unionByName(tally(after, cfg)))


def _of(tallies: DataFrame, measure: str) -> DataFrame:
    return tallies.where(F.col("measure") == measure)


def _in_order(tallies: DataFrame, group: Column, values: list, name: str) -> DataFrame:
    """Counts of a fixed list of groups in its order, zeros included."""
    places = range(len(values))
    counts = tallies.select(group.alias(name), "n").agg(
        *[F.coalesce(F.sum(F.when(F.col(name) == F.lit(values[i]), F.col("n"))), F.lit(0)).alias(f"n{i}") for i in places]
    )
    rows = [F.struct(F.lit(i).alias("position"), F.lit(values[i]).alias(name), F.col(f"n{i}").alias("n")) for i in places]
    return counts.select(F.inline(F.array(*rows)))


def funnel_counts(tallies: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """Participants per funnel stage, in label order."""
    counts = _in_order(_of(tallies, "stage"), F.col("a"), sorted(cfg.status_labels.values()), "stage")
    return counts.withColumn("label", funnel_label(F.col("stage")))


def section_counts(tallies: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """Active participants per section, in walking order."""
    counts = _in_order(_of(tallies, "section"), F.col("a"), cfg.sections, "section")
    return counts.withColumn("label", section_label(F.col("section"), cfg))


def school_stats(tallies: DataFrame) -> DataFrame:
    """Participants, completions and completion rate per school, best school first."""

    def part(measure: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("measure") == measure, F.col("n"))), F.lit(0))

    stats = tallies.where(F.col("measure").isin("school", "school id", "school done")).groupBy(F.col("a").alias("school"))
    stats = stats.agg(part("school id").alias("total"), part("school done").alias("completed"))
    share = F.when(F.col("total") > 0, round1(F.col("completed") / F.col("total") * 100.0)).otherwise(F.lit(0.0))
    pending = (F.col("total") - F.col("completed")).alias("pending")
    return stats.select("school", "total", "completed", pending, share.alias("pct")).orderBy(F.desc("pct"), "school")


def kpis(tallies: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """Total, completed, active and late participants, in one row."""

    def count(hit: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias(name)

    late = (F.col("measure") == "status") & F.col("a").isin(*cfg.call_lists["late"])
    whole = [count((F.col("measure") == "all") & (F.col("a") == name), name) for name in ("total", "completed", "active")]
    return tallies.agg(*whole, count(late, "late"))


def _bucket(as_of: datetime, cfg: ProgressConfig) -> Column:
    return F.least(weeks_since(clock(as_of), F.col("at")), F.lit(len(cfg.cohort_labels) - 1))


def cohort_counts(tallies: DataFrame, as_of: datetime, cfg: ProgressConfig) -> DataFrame:
    """Participants per cohort bucket, zeros included."""
    counts = _in_order(_of(tallies, "cohort"), _bucket(as_of, cfg), list(range(len(cfg.cohort_labels))), "bucket")
    return counts.select("bucket", F.get(F.array(*map(F.lit, cfg.cohort_labels)), F.col("bucket")).alias("label"), "n")


def cohort_status(tallies: DataFrame, as_of: datetime, cfg: ProgressConfig) -> DataFrame:
    """Participants per cohort bucket and status."""
    rows = _of(tallies, "cohort").groupBy(_bucket(as_of, cfg).alias("bucket"), F.col("a").alias("status"))
    return rows.agg(F.sum("n").alias("n")).orderBy("bucket", "status")


def filter_values(tallies: DataFrame) -> DataFrame:
    """Schools and statuses to filter by."""
    rows = tallies.where(F.col("measure").isin("school", "status") & (F.col("a") != ""))
    return rows.select(F.col("measure").alias("filter"), F.col("a").alias("value")).orderBy("filter", "value")


def call_list_counts(tallies: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """Size of each call list, zeros included."""
    return _in_order(_of(tallies, "status"), call_list(F.col("a"), cfg), list(cfg.call_lists), "call_list").select("call_list", "n")

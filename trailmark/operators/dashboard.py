"""Dashboard aggregates, lists and cards over processed participants.

Counts over a fixed set of groups are one aggregate without keys: a counter per
group, so empty groups show as zero and a task hands on a single row.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.config import DEFAULT_CONFIG, ProgressConfig
from trailmark.functions.numbers import round1, to_completed
from trailmark.functions.screens import badge, funnel_label, lookup, section_label, section_of
from trailmark.functions.text import date_prefix, full_name, text_of
from trailmark.functions.timestamps import weeks_since
from trailmark.operators.funnel import ENROLLED, with_enrolment
from trailmark.operators.participants import clock
from trailmark.operators.schema import ensure_schema, processed_types
from trailmark.sources.snapshots import Snapshot


def dashboard_input(df: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """Any roster, processed or not, with all columns the dashboard reads."""
    return processed_types(ensure_schema(df, cfg), cfg)


def _count_by(df: DataFrame, group: Column, values: list, name: str) -> DataFrame:
    """Rows per value of a fixed list, in its order, zeros included; other values do not count."""
    places = range(len(values))
    counts = df.select(group.alias(name)).agg(
        *[F.count_if(F.col(name) == F.lit(values[i])).alias(f"n{i}") for i in places]
    )
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(values[i]).alias(name), F.col(f"n{i}").alias("n")) for i in places
    ]
    return counts.select(F.inline(F.array(*rows)))


def records(df: DataFrame, as_of: datetime, cfg: ProgressConfig) -> DataFrame:
    """One display row per participant."""
    df = with_enrolment(df, cfg)
    return df.select(
        F.coalesce(F.replace(text_of(df, "id"), F.lit(".0"), F.lit("")), F.lit("")).alias("id"),
        "school",
        full_name(F.col("adult_name"), F.col("adult_surname")).alias("name"),
        "phone",
        date_prefix(df, ENROLLED).alias("enrolled_on"),
        date_prefix(df, "first_log_text").alias("first_log_on"),
        date_prefix(df, "expected_end_at").alias("expected_end_on"),
        date_prefix(df, "finished_at").alias("finished_on"),
        "current_screen",
        round1(F.coalesce("progress_pct", F.lit(0.0))).alias("progress"),
        "days_since_use",
        "state",
        to_completed(F.col("completed")).alias("completed"),
        "status",
        weeks_since(clock(as_of), F.col(ENROLLED)).alias("weeks_enrolled"),
        "comments",
    )


def cohort_weeks(df: DataFrame, as_of: datetime, cfg: ProgressConfig) -> DataFrame:
    """Weeks since enrolment and the cohort bucket of every participant."""
    weeks = weeks_since(clock(as_of), F.col(ENROLLED))
    return (
        with_enrolment(df, cfg)
        .withColumn("weeks_enrolled", weeks)
        .withColumn("bucket", F.when(F.col("weeks_enrolled").isNotNull(), F.least("weeks_enrolled", F.lit(len(cfg.cohort_labels) - 1))))
        .drop(ENROLLED)
    )


def funnel_counts(df: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """Participants per funnel stage, in label order."""
    stages = sorted(cfg.status_labels.values())
    counts = _count_by(df, F.col("status_ordered"), stages, "stage")
    return counts.withColumn("label", funnel_label(F.col("stage")))


def section_counts(df: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """Active participants per section, in walking order; unknown sections are not shown."""
    active = F.col("status").rlike(cfg.active_status_pattern)
    section = F.when(active, section_of(F.col("current_screen")))
    counts = _count_by(df, section, cfg.sections, "section")
    return counts.withColumn("label", section_label(F.col("section"), cfg))


def school_stats(df: DataFrame) -> DataFrame:
    """Participants, completions and completion rate per school, best school first."""
    done = F.when(to_completed(F.col("completed")), 1).otherwise(0)
    stats = (
        df.where(F.col("school").isNotNull())
        .groupBy("school")
        .agg(F.count("id").alias("total"), F.sum(done).alias("completed"))
    )
    share = round1(F.col("completed") / F.col("total") * 100.0)
    return stats.select(
        "school",
        "total",
        "completed",
        (F.col("total") - F.col("completed")).alias("pending"),
        F.when(F.col("total") > 0, share).otherwise(F.lit(0.0)).alias("pct"),
    ).orderBy(F.desc("pct"), "school")


def kpis(df: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """Total, completed, active and late participants, in one row."""
    done = to_completed(F.col("completed"))
    late = F.col("status").isin(*cfg.call_lists["late"])
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("completed"),
        F.count_if(F.col("first_log_text").isNotNull() & ~done).alias("active"),
        F.count_if(late).alias("late"),
    )


def cohort_counts(df: DataFrame, as_of: datetime, cfg: ProgressConfig) -> DataFrame:
    """Participants per cohort bucket, zeros included."""
    buckets = list(range(len(cfg.cohort_labels)))
    counts = _count_by(cohort_weeks(df, as_of, cfg), F.col("bucket"), buckets, "bucket")
    labels = F.array(*map(F.lit, cfg.cohort_labels))
    return counts.select("bucket", F.get(labels, F.col("bucket")).alias("label"), "n")


def cohort_members(df: DataFrame, bucket: int, as_of: datetime, cfg: ProgressConfig) -> DataFrame:
    """Participants of one cohort bucket; the last one is open-ended."""
    return cohort_weeks(df, as_of, cfg).where(F.col("bucket") == bucket)


def cohort_status(df: DataFrame, as_of: datetime, cfg: ProgressConfig) -> DataFrame:
    """Participants per cohort bucket and status."""
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit(cfg.unknown)).alias("status")
    rows = cohort_weeks(df, as_of, cfg).where(F.col("bucket").isNotNull())
    return rows.groupBy("bucket", status).agg(F.count(F.lit(1)).alias("n")).orderBy("bucket", "status")


def filter_values(df: DataFrame) -> DataFrame:
    """Distinct schools and statuses to filter by, from one pass over the rows."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("filter"), F.col(c).alias("value")) for c in ("school", "status")]
    )
    return df.select(F.inline(pairs)).where(F.col("value") != "").distinct().orderBy("filter", "value")


def call_list(status: Column, cfg: ProgressConfig) -> Column:
    """Call list a status is on, NULL if on none."""
    return lookup({s: name for name, group in cfg.call_lists.items() for s in group}, status)


def call_lists(rows: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """Display rows that are on a call list, with its name."""
    return rows.withColumn("call_list", call_list(F.col("status"), cfg)).where(F.col("call_list").isNotNull())


def call_list_counts(df: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """Size of each call list, zeros included."""
    counts = _count_by(df, call_list(F.col("status"), cfg), list(cfg.call_lists), "call_list")
    return counts.select("call_list", "n")


def search(rows: DataFrame, text: str = "", school: str = "", status: str = "") -> DataFrame:
    """Display rows whose id, name or phone contains a text, of one school and status if given."""
    needle = F.lit(text.lower())
    hit = (
        F.contains("id", needle)
        | F.contains(F.lower("name"), needle)
        | F.contains(F.coalesce("phone", F.lit("")), needle)
    )
    found = rows.where(hit)
    if school:
        found = found.where(F.col("school") == school)
    if status:
        found = found.where(F.col("status") == status)
    return found


def cards(rows: DataFrame, cfg: ProgressConfig = DEFAULT_CONFIG) -> DataFrame:
    """Detail cards of display rows."""
    last_active = F.when(F.col("first_log_on").isNotNull(), F.coalesce("finished_on", "first_log_on"))
    return rows.select(
        "id",
        "name",
        "school",
        "phone",
        "status",
        badge(F.col("status"), cfg).alias("badge"),
        "current_screen",
        "progress",
        "first_log_on",
        "expected_end_on",
        F.coalesce(last_active, F.lit(cfg.no_activity)).alias("last_active"),
        "days_since_use",
        "comments",
    )


def card(rows: DataFrame, participant_id: str, cfg: ProgressConfig = DEFAULT_CONFIG) -> DataFrame:
    """Detail card of one participant."""
    return cards(rows.where(F.col("id") == participant_id), cfg)


def screen_labels(df: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """Add the name of the current screen, NULL if it has none."""
    return df.withColumn("screen_label", lookup(cfg.screen_labels, F.col("current_screen")))


def refresh_counts(processed: DataFrame, pending: DataFrame) -> DataFrame:
    """Rows updated and pending contacts found by a refresh, in one row; counts tables that are not written anywhere."""
    marks = processed.select(F.lit("updated").alias("kind")).unionAll(pending.select(F.lit("pending").alias("kind")))
    return marks.agg(
        F.count_if(F.col("kind") == "updated").alias("total_updated"),
        F.count_if(F.col("kind") == "pending").alias("pending_found"),
    )


def written_counts(snapshot: Snapshot, spark: SparkSession) -> DataFrame:
    """The same of the refresh that made a version, as counted while its tables were written."""
    counts = [(snapshot.rows.get("processed", 0), snapshot.rows.get("pending", 0))]
    return spark.createDataFrame(counts, "total_updated bigint, pending_found bigint")

"""From screen visits to one summary row per phone.

:func:`log_summary` is one aggregate by phone over numbers of a fixed width: every task combines its rows to one for each
phone in a hash table before anything is shuffled, so the log is shuffled once, is never sorted, and a phone with a third
of all visits does no harm.  Streams store :func:`screen_visits` instead, first and last visit per phone and screen,
which merge by minimum and maximum; :func:`summarise` makes the summary of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.config import ProgressConfig
from trailmark.functions.screens import section_index, section_of
from trailmark.functions.text import null_if_missing, with_phone_key
from trailmark.functions.timestamps import NTZ, parse_ts
from trailmark.sources.sheets import require_columns

VISIT_KEYS = ["phone_key", "screen"]
VISITS = "phone_key string, screen string, first_at timestamp_ntz, last_at timestamp_ntz"


def noise(entry: Column, cfg: ProgressConfig) -> Column:
    """Whether a log entry is a notification and not use; NULL entries are use."""
    pattern = "(?iu)" + "|".join(cfg.noise_patterns)
    return F.coalesce(entry, F.lit("")).rlike(pattern)


def drop_noise(logs: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """Logs without notification entries; unchanged if they have no entry text."""
    if "entry" not in logs.columns:
        return logs
    return logs.where(~noise(F.col("entry"), cfg))


def with_visit_columns(logs: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """Add ``phone_key`` and ``visited_at``; the latter is NULL on rows that do not count."""
    require_columns(logs, ["phone", "entered_at", "screen"])
    entered = F.col("entered_at")
    if logs.schema["entered_at"].dataType.typeName() == "string":
        visited = parse_ts(entered, cfg.dayfirst_fallback)
    else:
        visited = entered.cast(NTZ)
    return with_phone_key(logs, "phone").withColumn("visited_at", F.when(F.col("phone_key") != "", visited))


def valid_logs(logs: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """Rows of real use with a full phone and a readable time.

    A filter is copied below the columns it tests, and the time would be parsed
    twice; it stays where it is above a column that is not deterministic.
    """
    rows = with_visit_columns(drop_noise(logs, cfg), cfg).withColumn("_partition", F.spark_partition_id())
    return rows.where(F.col("visited_at").isNotNull() & (F.col("_partition") >= 0)).drop("_partition")


def _visit_rows(logs: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """Phone, screen and time of log rows.

    Invalid rows have a NULL time, which minimum and maximum skip; filtering the
    groups afterwards keeps the costly time parsing out of a pushed-down filter,
    where it would run a second time for every log row.
    """
    return with_visit_columns(drop_noise(logs, cfg), cfg).select(
        "phone_key", null_if_missing(F.col("screen")).alias("screen"), "visited_at"
    )


def screen_visits(logs: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """First and last visit per phone and screen."""
    return (
        _visit_rows(logs, cfg)
        .groupBy(*VISIT_KEYS)
        .agg(F.min("visited_at").alias("first_at"), F.max("visited_at").alias("last_at"))
        .where(F.col("first_at").isNotNull())
    )


def merge_visits(visits: DataFrame) -> DataFrame:
    """Visits of several runs put together."""
    return visits.groupBy(*VISIT_KEYS).agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )


def _summary(rows: DataFrame, first: str, last: str, cfg: ProgressConfig) -> DataFrame:
    """One row per phone of rows with a screen and the first and last time it was seen.

    Equal times are settled by the screen name; rows without a time do not count.
    """
    screen, timed = F.col("screen"), F.col(last).isNotNull()
    index = section_index(section_of(screen), cfg)
    latest = F.struct(F.col(last).alias("at"), screen)
    furthest = F.struct(index.alias("index"), F.col(last).alias("at"), screen)
    return (
        rows.groupBy("phone_key")
        .agg(
            F.min(first).alias("first_log_at"),
            F.max(last).alias("last_used_at"),
            F.max(F.when(timed & screen.isNotNull(), latest)).alias("last"),
            F.max(F.when(timed & (index >= 0), furthest)).alias("furthest"),
            F.min(F.when(screen.isin(*cfg.final_screens), F.col(first))).alias("finished_at"),
        )
        .where(F.col("first_log_at").isNotNull())
        .select(
            "phone_key",
            "first_log_at",
            "last_used_at",
            F.col("last.screen").alias("last_screen"),
            F.col("furthest.screen").alias("furthest_screen"),
            F.coalesce("furthest.screen", "last.screen").alias("effective_screen"),
            "finished_at",
        )
    )


def summarise(visits: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """One row per phone: first and last use, last, furthest and effective screen, first completion."""
    return _summary(visits, "first_at", "last_at", cfg)


#: A dictionary of more screens, of more in one section, or of longer names, is not sent to every task.
MOST_SCREENS, MOST_IN_SECTION, LONGEST_SCREEN = 900, 50, 200
#: Microseconds between the epoch and any time that can be read are fewer than this.
_REACH = 9_300_000_000_000_000


@dataclass(frozen=True)
class Screens:
    """All screens of a log in order, with the section each belongs to and its place among the screens of that section."""

    rows: list[tuple[str, int, int, int, bool]]

    @classmethod
    def of(cls, names: Iterable[str], cfg: ProgressConfig) -> Screens | None:
        """The dictionary of these names; None if it would be too large, or times and screens do not fit into a number."""
        sections = {s: i for i, s in enumerate(cfg.sections)}
        rows, seen = [], Counter()
        for rank, name in enumerate(sorted(names, key=lambda n: n.encode())):
            index = sections.get(name.split("_")[0] if "_" in name else name[:6], -1)
            rows.append((name, rank, index, seen[index], name in cfg.final_screens))
            seen[index] += index >= 0
        fits = 2 * _REACH * MOST_IN_SECTION * (len(sections) + 1) < 1 << 64
        small = len(rows) <= MOST_SCREENS and max(seen.values(), default=0) <= MOST_IN_SECTION
        return cls(rows) if fits and small and all(len(r[0]) <= LONGEST_SCREEN for r in rows) else None

    @classmethod
    def found_in(cls, logs: DataFrame, cfg: ProgressConfig) -> Screens | None:
        """The dictionary of a log, from one pass over its screen column; None if it would be too large."""
        names = logs.select(F.left(null_if_missing(F.col("screen")), F.lit(LONGEST_SCREEN + 1)).alias("screen"))
        found = names.where("screen is not null").distinct().limit(MOST_SCREENS + 1).collect()
        return cls.of((r.screen for r in found), cfg)

    def table(self, spark: SparkSession) -> DataFrame:
        """(screen, rank, index, place, final), no more rows than ``MOST_SCREENS``."""
        kinds = {"screen": pa.string(), "rank": pa.int32(), "index": pa.int32(), "place": pa.int32(), "final": pa.bool_()}
        cells = zip(*self.rows, strict=True) if self.rows else [[]] * len(kinds)
        return F.broadcast(spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(cells, kinds.values(), strict=True)], list(kinds))))


def _packed_summary(rows: DataFrame, screens: Screens, cfg: ProgressConfig) -> DataFrame:
    """The summary of rows with a phone, a screen of the dictionary and a time, by numbers alone.

    Time and rank of the screen are the digits of one number that orders as they do, and so are section, time and place
    of the screen in its section.  All buffers of the aggregate are numbers, kept up to date in a hash table.
    """
    spark, at = rows.sparkSession, F.col("visited_at")
    micros = F.unix_micros(at.cast("timestamp"))
    seen = rows.join(screens.table(spark), "screen", "left").withColumn("_at", micros)
    last = F.col("_at") * MOST_SCREENS + F.col("rank")
    # sections from the middle of the range of numbers on, so that both signs are used
    half = len(cfg.sections) // 2
    furthest = ((F.col("index") - half) * (2 * _REACH) + F.col("_at")) * MOST_IN_SECTION + F.col("place")
    grouped = seen.groupBy("phone_key").agg(
        F.min("visited_at").alias("first_log_at"),
        F.max("visited_at").alias("last_used_at"),
        F.max(last).alias("_last"),
        F.max(F.when(F.col("index") >= 0, furthest)).alias("_furthest"),
        F.min(F.when(F.col("final"), at)).alias("finished_at"),
    )
    step = F.expr(f"(_furthest - pmod(_furthest, {MOST_IN_SECTION})) div {MOST_IN_SECTION} + {_REACH}")
    found = grouped.where(F.col("first_log_at").isNotNull()).withColumns(
        {
            "_rank": F.pmod("_last", F.lit(MOST_SCREENS)).cast("int"),
            "_place": F.pmod("_furthest", F.lit(MOST_IN_SECTION)).cast("int"),
            "_index": (F.floor((step - F.pmod(step, F.lit(2 * _REACH))) / (2 * _REACH)) + half).cast("int"),
        }
    )
    by_rank = screens.table(spark).select(F.col("rank").alias("_rank"), F.col("screen").alias("last_screen"))
    by_place = screens.table(spark).where("index >= 0").select(
        F.col("index").alias("_index"), F.col("place").alias("_place"), F.col("screen").alias("furthest_screen")
    )
    named = found.join(F.broadcast(by_rank), "_rank", "left").join(F.broadcast(by_place), ["_index", "_place"], "left")
    effective = F.coalesce("furthest_screen", "last_screen").alias("effective_screen")
    return named.select("phone_key", "first_log_at", "last_used_at", "last_screen", "furthest_screen", effective, "finished_at")


def log_summary(logs: DataFrame, cfg: ProgressConfig, screens: Screens | None = None) -> DataFrame:
    """Summary of the valid logs, one row per phone, in one shuffle.

    ``screens`` is the dictionary of the log's screens, if it is known; otherwise one pass over that column makes it.  A
    log with too many different screens for a dictionary goes by its visits, in two shuffles.
    """
    require_columns(logs, ["phone", "entered_at", "screen"])
    screens = screens or Screens.found_in(logs, cfg)
    if screens is None:
        return summarise(screen_visits(logs, cfg), cfg)
    return _packed_summary(_visit_rows(logs, cfg), screens, cfg)

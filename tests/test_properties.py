"""Properties over random inputs; every example is one small Spark job."""

from __future__ import annotations

from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmark.config import DEFAULT_CONFIG as CFG
from trailmark.functions.cells import differs
from trailmark.functions.timestamps import floor_days, swap_day_month
from trailmark.operators.logs import merge_visits, screen_visits, summarise

FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
TIMES = st.datetimes(datetime(1990, 1, 1), datetime(2100, 1, 1))


@FEW
@given(st.lists(st.tuples(TIMES, TIMES), min_size=30, max_size=60))
def test_floor_days_is_timedelta_days(spark, pairs):
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(floor_days(F.col("a"), F.col("b"))).collect()]
    assert got == [(a - b).days for a, b in pairs]


@FEW
@given(st.lists(TIMES.map(lambda t: t.replace(microsecond=0)), min_size=30, max_size=60))
def test_swapping_twice_gives_the_date_back(spark, times):
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    once = df.withColumn("s", swap_day_month(F.col("t")))
    got = [tuple(r) for r in once.select("t", swap_day_month(F.col("s"))).collect()]
    assert all(t == back for t, back in got)


CELLS = st.one_of(st.none(), st.sampled_from(["", "nan", "1", "1.0", "True", "0", "false", "2024-01-02", "02/01/2024"]), st.text(max_size=5))


@FEW
@given(st.lists(st.tuples(CELLS, CELLS), min_size=30, max_size=60))
def test_differs_is_symmetric_and_false_on_equal_cells(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select(differs(a, b).alias("x"), differs(b, a).alias("y"), differs(a, a).alias("z")).collect()
    assert all(r.x == r.y and r.z is False for r in rows)


SCREENS = ["L1B1S0_15", "L1B2S1_3", "L2B3S4_15", "L2B3S4_14", "X9Z9", None, "nan"]
LOGS = st.lists(
    st.tuples(
        st.sampled_from(["911111111", "+56 922222222", "123", None]),
        st.sampled_from(["2024-01-01 10:00:00", "2024-01-01 10:00:00", "02/01/2024 09:00:00", "bad", None]),
        st.sampled_from(SCREENS),
        st.sampled_from(["Uso", "PUSH NOTIFICATION", None]),
    ),
    min_size=1,
    max_size=40,
)


@FEW
@given(LOGS, LOGS)
def test_merging_visits_is_reducing_the_union(spark, first, second):
    schema = "phone string, entered_at string, screen string, entry string"
    parts = [spark.createDataFrame(rows, schema) for rows in (first, second)]
    merged = merge_visits(screen_visits(parts[0], CFG).unionByName(screen_visits(parts[1], CFG)))
    whole = screen_visits(parts[0].unionByName(parts[1]), CFG)
    assert sorted(map(str, summarise(merged, CFG).collect())) == sorted(map(str, summarise(whole, CFG).collect()))

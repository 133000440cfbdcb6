"""What the physical plans must and must not contain."""

from __future__ import annotations

import re
from contextlib import redirect_stdout
from datetime import date, datetime
from io import StringIO

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from checks.views import view
from trailmark.config import DEFAULT_CONFIG as CFG
from trailmark.operators import dashboard
from trailmark.operators.logs import Screens, log_summary, screen_visits, summarise, valid_logs
from trailmark.operators.schema import processed_types
from trailmark.plans.refresh import refresh_participants
from trailmark.sources import keyed
from trailmark.sources.log_scan import scan_logs
from trailmark.sources.snapshots import SnapshotStore

SF = "/root/testdata/sf0.001"
AS_OF = datetime(2024, 1, 31)


def plan(df) -> str:
    out = StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def tree(df) -> str:
    """Operators without their details."""
    return plan(df).split("\n\n")[0]


@pytest.fixture(scope="module")
def raw_logs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("logs"))
    view(spark, SF, "fx_logs").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_query_needs_python_workers_or_pairs_up_rows(spark):
    for name in ("refresh", "export_diff", "records", "section_counts", "pending_contacts", "apply_comments"):
        text = plan(QUERIES[name](spark, SF))
        assert not re.search("Python|ArrowEval|CartesianProduct|BroadcastNestedLoop", text), name


def test_visits_are_combined_in_a_hash_table_before_the_shuffle(raw_logs):
    operators = tree(screen_visits(raw_logs, CFG))
    assert operators.count("Exchange") == 1 and "Sort" not in operators
    assert operators.count("HashAggregate") == 2


def test_summary_shuffles_logs_once_and_sorts_nothing(raw_logs):
    operators = tree(log_summary(raw_logs, CFG))
    assert operators.count(" Exchange") == 1 and operators.count("Scan parquet") == 1
    assert operators.count("HashAggregate") == 2 and "Sort" not in operators and "Object" not in operators


def test_a_log_of_many_screens_goes_by_its_visits(spark, raw_logs):
    few = raw_logs.where("event_id % 2 = 0")
    many = raw_logs.withColumn("screen", F.expr("if(event_id % 2 = 0, 'L1B1S0_' || event_id % 500, screen)"))
    assert Screens.found_in(many, CFG) is None and Screens.found_in(few, CFG) is not None
    assert sorted(map(str, log_summary(many, CFG).collect())) == sorted(map(str, summarise(screen_visits(many, CFG), CFG).collect()))


def test_upsert_reduces_new_rows_only(spark, no_broadcast):
    old, new = view(spark, SF, "fx_state_old"), view(spark, SF, "fx_state_new")
    operators = tree(keyed.upsert_latest(old, new))
    old_side = operators[operators.index(":- Sort") : operators.index("         +- Sort")]
    assert "SortMergeJoin FullOuter" in operators and "Aggregate" not in old_side and "Scan parquet" in old_side
    assert operators.count("SortAggregate") == 2  # partial and final, of the new rows


def test_counters_cost_no_second_run(spark, tmp_path):
    snapshot = SnapshotStore(spark, str(tmp_path)).write("1", {"processed": view(spark, SF, "fx_participants")})
    assert "Scan parquet" not in tree(dashboard.written_counts(snapshot, spark))
    assert dashboard.written_counts(snapshot, spark).first().asDict() == {"total_updated": 150, "pending_found": 0}


def test_times_are_parsed_once_per_log_row(raw_logs):
    iso_gate = re.escape("(?:167[89]|")
    for df in (log_summary(raw_logs, CFG), screen_visits(raw_logs, CFG), valid_logs(raw_logs, CFG)):
        filters = [part for part in plan(df).split("\n\n") if re.match(r"\(\d+\) Filter", part)]
        assert filters and not any(re.search(iso_gate, f) for f in filters)


def test_log_scan_reads_only_its_columns_and_pushes_bounds(spark, raw_logs):
    text = plan(log_summary(raw_logs, CFG))
    assert "ReadSchema: struct<phone:string,entered_at:string,screen:string,entry:string>" in text
    events = spark.read.parquet(f"{SF}/events.parquet")
    text = plan(scan_logs(events, date(2024, 1, 10), datetime(2024, 1, 20), CFG, "ts").select("event_id"))
    pushed = re.search(r"PushedFilters: \[(.*)\]", text).group(1)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_day_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("day", F.to_date("ts"))
    events.write.partitionBy("day").parquet(path)
    logs = scan_logs(spark.read.parquet(path), date(2024, 1, 10), datetime(2024, 1, 11), CFG, "ts", "day")
    assert re.search(r"PartitionFilters: \[.*day.*2024-01-10", plan(logs))
    assert logs.count() == events.where("day between '2024-01-10' and '2024-01-11'").count()


def test_refresh_scans_logs_once_and_joins_by_sort_at_scale(spark, raw_logs, no_broadcast):
    people = view(spark, SF, "fx_participants")
    text = tree(refresh_participants(people, log_summary(raw_logs, CFG), AS_OF, CFG))
    assert "SortMergeJoin LeftOuter" in text
    assert "SortMergeJoin" not in text.split("SortMergeJoin", 1)[1]
    # Roster and logs are read once; the summary joins as it was shuffled for its aggregate.
    assert text.count("Scan parquet") == 2 and text.count(" Exchange") == 2


def test_fixed_counts_need_one_row_per_task(spark, tmp_path):
    path = str(tmp_path / "t")
    processed_types(view(spark, SF, "fx_participants"), CFG).write.parquet(path)
    stored = spark.read.parquet(path)
    for df in (dashboard.funnel_counts(stored, CFG), dashboard.kpis(stored, CFG), dashboard.section_counts(stored, CFG)):
        operators = tree(df)
        assert operators.count("Exchange") == 1 and "Join" not in operators
    assert "ReadSchema: struct<status_ordered:string>" in plan(dashboard.funnel_counts(stored, CFG))
    rows = dashboard.search(dashboard.records(stored, AS_OF, CFG), "ana", "BUILDING")
    assert "EqualTo(school,BUILDING)" in plan(rows)

"""What the physical plans must and must not contain."""
import re

import pytest
from pyspark.sql import functions as F

from skyledger.operators import snapshots
from skyledger.plans import catalog, staging
from skyledger.sources import testdata as td

D = "/root/testdata/sf0.001"
NEVER = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """As if no side were small."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", [
    "rotation_edges", "tail_propagation", "flights_with_weather", "same_metro_edges", "congestion_edges", "traffic_load", "airport_snapshots",
    "flight_snapshots", "departs_from_edges", "threshold_sweep_fine", "flight_tracking", "replay_day", "point_requests", "taxi_uplift", "live_flight_features"])
def test_no_nested_loops_and_no_python(no_broadcast, name):
    assert not NEVER.search(plan(catalog.QUERIES[name](no_broadcast, D)))


def test_scan_reads_only_what_is_needed(spark):
    text = plan(snapshots.flight_keys(td.flight_times(spark, D)).select("flight_id", "horizon_h"))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all("props" not in s and "event_type" not in s for s in schemas)


def test_date_filter_reaches_the_scan(spark):
    fl = staging.stage(td.flights(spark, D))
    from skyledger.operators import clean
    assert "PushedFilters: [IsNotNull(dep_datetime), GreaterThanOrEqual(dep_datetime" in fl.sparkSession._jvm.PythonSQLUtils.explainString(
        clean.on_date(fl, "2024-01-10")._jdf.queryExecution(), "formatted")


def test_top_rows_are_limited_before_the_exchange(spark):
    text = plan(catalog.QUERIES["replay_top_rows"](spark, D))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_flights_are_shuffled_once_for_flight_snapshots(spark):
    """Only the tail window moves the flights; what else moves by tail are aggregates, one row a tail and slot."""
    lines = plan(catalog.QUERIES["flight_snapshots"](spark, D)).splitlines()
    under = [below for line, below in zip(lines, lines[1:]) if "Exchange hashpartitioning(" in line and "Tail_Number" in line]
    assert under and sum("Aggregate" not in below for below in under) == 1


def test_staged_tables_live_in_the_shared_folder_and_leave_with_the_scope(spark):
    import os

    with staging.scope(spark):
        path = staging.stage(spark.range(3)).inputFiles()[0].removeprefix("file://")
        assert path.startswith(staging.shared_folder(spark).removeprefix("file:").removeprefix("//")) and os.path.exists(path)
    assert not os.path.exists(path)
    kept = staging.stage(spark.range(3)).inputFiles()[0].removeprefix("file://")
    assert os.path.exists(kept)


@pytest.mark.parametrize("name", ["replay_day", "replay_summary", "flight_tracking"])
def test_the_prediction_log_is_not_broadcast(spark, name):
    """Its rows come from an explode, whose growth Spark's size estimate leaves out."""
    lines = plan(catalog.QUERIES[name](spark, D)).splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            under = [b for b in lines[at + 1:]]
            end = next((k for k, b in enumerate(under) if depth(b) <= depth(line)), len(under))
            assert not any("Generate explode(" in b and "flight_id" in b for b in under[:end])


def test_flight_rows_meet_their_edges_without_a_broadcast_and_only_with_the_columns_read(spark):
    text = plan(catalog.QUERIES["neighbour_context"](spark, D))
    lines = [line for line in text.splitlines() if "Join" in line and line.count("flight_id") > 1]
    assert lines and all("SortMergeJoin" in line for line in lines)
    paths = set(re.findall(r"(/[^ ,\]]*/flight-rows-[0-9a-f]+)", text))
    assert paths and all(len(spark.read.parquet(p).columns) == 7 for p in paths)

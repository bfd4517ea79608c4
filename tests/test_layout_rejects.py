import re

import pytest
from pyspark.sql import functions as F

from helpers import as_set
from skyledger.operators import quality, rotation
from skyledger.plans import layout, staging
from skyledger.sources import rejects, testdata as td
from skyledger.sources.schemas import OBSERVATION_FEED
from skyledger.sources.weather import decode_records
from test_plans import no_broadcast, plan  # noqa: F401

D = "/root/testdata/sf0.001"


def test_clustered_flights_are_not_moved(no_broadcast, tmp_path):  # noqa: F811
    """Above the scan of the clustered table there is no exchange of legs; what moves are summaries of a tail's day."""
    spark = no_broadcast
    by_tail = layout.flights_by_tail(td.flights(spark, D), "clustered_legs", f"{tmp_path}/t", buckets=4)
    edges = rotation.rotation_edges(by_tail)
    lines = plan(edges).splitlines()
    moved = [k for k, line in enumerate(lines) if "Exchange hashpartitioning(" in line]
    # Every exchange stands right above the summaries of the days or the links between them.
    assert len(moved) == 2 and "Window" in "".join(lines[moved[0] + 1:moved[0] + 4]) and "Aggregate" in lines[moved[1] + 1], plan(edges)
    assert "Bucketed: true" in plan(edges)
    cols = ["leg1_flight_id", "leg2_flight_id", "turnaround_min"]
    assert as_set(edges, *cols) == as_set(rotation.rotation_edges(td.flights(spark, D)), *cols)
    spark.sql("DROP TABLE clustered_legs")
    again = layout.reopen(spark, "clustered_legs", f"{tmp_path}/t", layout.TAIL_KEYS, ["dep_datetime", "flight_id"], 4)
    assert "Bucketed: true" in plan(rotation.rotation_edges(again)) and as_set(rotation.rotation_edges(again), *cols) == as_set(edges, *cols)
    spark.sql("DROP TABLE clustered_legs")


def test_only_wanted_days_are_read(spark, tmp_path):
    layout.write_by_day(td.flights(spark, D), f"{tmp_path}/d")
    by_day = spark.read.parquet(f"{tmp_path}/d")
    days = staging.stage(by_day.select("dep_day").distinct().withColumn("rank", F.dayofmonth("dep_day") - 4))
    found = layout.on_days(by_day, days.where("rank between 1 and 2"))
    text = plan(found)
    assert re.search(r"PartitionFilters: \[.*dynamicpruning", text), text[:3000]
    rows = found.collect()
    assert {str(r.dep_day) for r in rows} == {"2024-01-05", "2024-01-06"}
    assert len(rows) == by_day.where("dep_day between '2024-01-05' and '2024-01-06'").count()


def test_checks_on_the_way_are_those_of_the_passes(spark):
    fl = staging.stage(td.flights(spark, D))
    rows, seen = quality.watched(td.flights(spark.newSession(), D))
    staging.stage(rows)
    got = quality.observed(spark, seen, fl.columns, years=(2024, 2024))
    expected = quality.basics(fl, years=(2024, 2024)).unionByName(quality.delays(fl)).unionByName(quality.temporal(fl))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())) and got.count() > 10


def test_sketches_of_days_merge(spark):
    rows = spark.range(20_000).select((F.col("id") % 5000).cast("string").alias("v"), F.lit("2022-01-01").cast("date").alias("d0"), (F.col("id") % 7).cast("int").alias("k"))
    df = rows.select("v", F.date_add("d0", F.col("k")).cast("timestamp_ntz").alias("dep_datetime"))
    found = quality.distinct_by(quality.day_sketches(df, ["v"]), F.lit(1), ["v"]).head()
    assert abs(found.v - 5000) < 150


def test_rejected_lines_are_those_not_decoded(spark):
    good = "0000" + "72259" + "0" + "03927" + "202201011200" + "4" + "+32900" + "-097040" + "FM-15" + "+0182" + "KDFW " + "V020" + "180" + "1" + "N" + "0050" + "1" + "99999" + "9" + "9" + "N" + "016000" + "1" + "N" + "1" + "+0100" + "1" + "+0050" + "1" + "10130" + "1"
    lines = [good, good[:40], None, "", good.replace("202201011200", "2022x1011200"), good[:60] + "zzz" + good[63:], good[:63]]
    df = spark.createDataFrame([(k, x, "f") for k, x in enumerate(lines)], "k long, value string, file string")
    kept = {r.k for r in decode_records(df).select("k").collect()}
    out = rejects.of_lines(df)
    assert out.count() + len(kept) == len(lines) and 0 in kept
    assert {r.reason for r in out.collect()} == {"record too short", "time not readable", "number not readable"}


def test_csv_rows_are_kept_or_given_a_reason(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,day,v\n1,2022-01-01,5\n2,,7\n3,2022-01-02,x\n4,nope,\n5,2022-01-03\n6,2022-01-04,1,9\n7,2022-01-05,\n")
    read = rejects.read_csv(spark, str(tmp_path), ["id", "day", "v"], {"day": F.try_to_timestamp("day", F.lit("yyyy-MM-dd")).isNotNull(),
                                                                      "v": F.col("v").try_cast("int").isNotNull()}, ["day"])
    assert {r.id for r in rejects.kept(read).collect()} == {"1", "3", "7"}
    got = {(r.row, r.reason, r.dropped) for r in rejects.of_rows(read).collect()}
    assert got == {("2,,7", "day: missing", True), ("3,2022-01-02,x", "v: not readable", False), ("4,nope,", "day: not readable", True),
                   ("5,2022-01-03", "number of values", True), ("6,2022-01-04,1,9", "number of values", True)}
    assert all(r.file.endswith("a.csv") for r in rejects.of_rows(read).collect())


@pytest.mark.parametrize("payload, reason", [('{"properties": {"windSpeed": {"value": 1}}}', None), ("{bad", "not the feed's JSON"), (None, "empty"), ("  ", "empty"), (" <Info/>", None)])
def test_payload_rejects(spark, payload, reason):
    found = rejects.of_payloads(spark.createDataFrame([(payload,)], "payload string"), OBSERVATION_FEED).collect()
    assert [r.reason for r in found] == ([reason] if reason else [])

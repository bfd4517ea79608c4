import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from skyledger.functions import expr as X


def one(spark, c, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(c.alias("r")).head().r


@pytest.mark.parametrize("policy,expected", [
    ("clamp", {0: 0, 5: 5, 2359: 1439, 2400: 0, None: 0, 1275: 12 * 60 + 59, 2512: 23 * 60 + 12}),
    ("clip", {0: 0, 5: 5, 2359: 1439, 2400: 23 * 60, None: 0, 1275: 12 * 60 + 59}),
    ("strict", {0: 0, 5: 5, 2359: 1439, 2400: None, None: None, 1275: None}),
])
def test_hhmm(spark, policy, expected):
    df = spark.createDataFrame([(k,) for k in expected], "t int")
    got = {r.t: r.m for r in df.select("t", X.hhmm_minutes("t", policy).alias("m")).collect()}
    assert got == expected


def test_tiers_and_status(spark):
    delays = [-1.0, 0.0, 14.9, 15.0, 60.0, 120.0, 240.0, 720.0, None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(delays)], "i int, d double")
    got = [r.t for r in df.orderBy("i").select(X.tier_order("d").alias("t")).collect()]
    assert got == [0, 1, 1, 2, 3, 4, 5, 6, None]
    labels = [r.t for r in df.orderBy("i").select(X.tier_label(X.tier_order("d")).alias("t")).collect()]
    assert labels[0] == "Early / On Time" and labels[7] == "Ultra (720+)" and labels[8] is None


@pytest.mark.parametrize("text,minutes", [
    ("1 hour 30 minutes", 90), ("45", 45), ("45.9", 45), ("2 hours", 120), ("15 min", 15), ("", 0), (None, 0), ("0", 0), ("1.5 hours", 0), ("soon", 0)])
def test_delay_text(spark, text, minutes):
    assert one(spark, X.delay_text_minutes("v"), text) == minutes


def test_codes_and_wind(spark):
    assert one(spark, X.icao_to_iata("v"), " katl ") == "ATL"
    assert one(spark, X.icao_to_iata("v"), "PANC") == "ANC"
    assert one(spark, X.icao_to_iata("v"), "KEY") == "KEY"
    assert one(spark, X.iata_to_icao("v"), "anc") == "PANC"
    assert one(spark, X.wind_text_ms("v"), "15 mph") == pytest.approx(15 * 0.44704)
    assert one(spark, X.wind_text_ms("v"), "calm") == 0.0


def test_hours_do_not_depend_on_the_session_zone(spark):
    """Across a clock change the zone-free difference stays the difference of the readings."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.sql("select timestamp_ntz'2022-03-13 01:30:00' a, timestamp_ntz'2022-03-13 03:30:00' b").select(
            X.minutes_between("a", "b").alias("m"), X.floor_hour("b").alias("f")).head()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row.m == 120.0 and row.f.hour == 3 and row.f.minute == 0


def test_rotation_risk_and_haversine(spark):
    row = spark.sql("select cast(null as double) a, 60D b, 30D c, 0D d").select(
        X.rotation_risk("a", "c").alias("none"), X.rotation_risk("b", "c").alias("two"), X.rotation_risk("b", "d").alias("tight"),
        X.haversine_km(F.lit(40.639), F.lit(-73.779), F.lit(40.777), F.lit(-73.873)).alias("km")).head()
    assert row.none == pytest.approx(1 / (1 + math.e))
    assert row.two == pytest.approx(1 / (1 + math.exp(-1)))
    assert row.tight == pytest.approx(1 / (1 + math.exp(-59)))
    assert row.km == pytest.approx(17.2, abs=0.3)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-0.5, 1.5), min_size=6, max_size=6))
def test_bucket_masses_sum_to_one(spark, probs):
    names = [f"p{i}" for i in range(6)]
    df = spark.createDataFrame([tuple(probs)], ", ".join(f"{n} double" for n in names))
    masses = list(df.select(*[v.alias(k) for k, v in X.bucket_masses(names).items()]).head())
    assert sum(masses) == pytest.approx(1.0)
    assert all(m >= -1e-12 for m in masses)


def test_step_index_matches_counting(spark):
    edges = [0.05 + 0.005 * i for i in range(181)]
    values = edges[::7] + [e - 1e-12 for e in edges[::7]] + [-1.0, 2.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", X.step_index("v", edges).alias("n")).collect():
        assert r.n == sum(r.v >= e for e in edges)


def test_masking(spark):
    df = spark.createDataFrame([(h / 24, 0.7) for h in (0.5, 1.0, 1.5, 2.0, 2.5)], "h double, c double")
    got = [tuple(r) for r in df.select(X.mask_by_horizon("c", "h", partial=False), X.mask_by_horizon("c", "h", partial=True)).collect()]
    assert got == [(0.7, 0.7), (0.7, 0.7), (0.7, 0.0), (0.7, 0.0), (0.0, 0.0)]


def test_pearson_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(X.pearson("a", "b")).head()[0] is None

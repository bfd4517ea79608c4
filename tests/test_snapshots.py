from pyspark.sql import functions as F

from helpers import as_set, flights, ts
from skyledger.operators import priors, rotation, snapshots
from skyledger.sources import testdata as td

D = "/root/testdata/sf0.001"


def day(t):
    return f"2022-01-01 {t}"


def test_window_and_bands(spark):
    df = flights(spark, [
        dict(flight_id=1, Tail_Number="N1", ORIGIN="A", DEST="B", dep=day("00:00"), arr=day("01:00"), DepDelay=1.0),
        dict(flight_id=2, Tail_Number="N2", ORIGIN="A", DEST="B", dep=day("10:00"), arr=day("11:00"), DepDelay=2.0),
        dict(flight_id=3, Tail_Number="N3", ORIGIN="A", DEST="B", dep=day("10:59"), arr=day("12:00"), DepDelay=None),
    ])
    keys = snapshots.flight_keys(df)
    by = {}
    for r in keys.collect():
        by.setdefault(r.flight_id, {})[r.snapshot_time.hour] = r
    assert set(by[1]) == {0}                                   # nothing before the grid
    assert set(by[2]) == set(range(3, 11)) and set(by[3]) == set(range(3, 11))
    assert [by[2][h].horizon_h for h in (10, 9, 8, 7, 6, 5, 4, 3)] == [0, 1, 1, 3, 3, 3, 6, 6]
    assert all(r.horizon_h is None and r.y == 0 for r in by[3].values())
    assert by[2][3].snap_idx == 3 and snapshots.hours(df).count() == 12


def test_every_flight_in_min_8_snapshots(spark):
    fl = td.flight_times(spark, D)
    counts = snapshots.flight_keys(fl).groupBy("flight_id").agg(F.count(F.lit(1)).alias("n"))
    first = snapshots.bounds(fl).head().first_hour
    for r in fl.join(counts, "flight_id").select("dep_datetime", "n").collect():
        assert r.n == min(8, int((r.dep_datetime - first).total_seconds() // 3600) + 1)


def _tables(spark, df, **kw):
    ap = spark.createDataFrame([("A",), ("B",), ("C",)], "airport string")
    pr = priors.airport_priors(df, hubs=1)
    known = priors.with_route_prior(rotation.tail_propagation(df, **kw), priors.route_stats(df), priors.global_stats(df))
    rot = rotation.rotation_edges(df)
    return ap, pr, rot, snapshots.flight_table(snapshots.enrich(known, rot, ap, pr), df, **kw)


def test_support_rows_and_inbound_override(spark):
    df = flights(spark, [
        dict(flight_id=1, Tail_Number="N1", ORIGIN="A", DEST="B", dep=day("05:00"), arr=day("06:30"), DepDelay=5.0, ArrDelay=60.0, Distance=2500.0),
        dict(flight_id=2, Tail_Number="N1", ORIGIN="B", DEST="C", dep=day("07:15"), arr=day("09:00"), DepDelay=50.0, ArrDelay=40.0, Distance=6000.0),
        dict(flight_id=3, Tail_Number="N1", ORIGIN="C", DEST="A", dep=day("09:30"), arr=day("10:00"), DepDelay=1.0, ArrDelay=1.0),
    ])
    ap, pr, rot, table = _tables(spark, df)
    rows = {(r.flight_id, r.snapshot_time.hour): r for r in table.collect()}
    # Flight 1 landed 06:30 before the 07:00 snapshot of flight 2, so it supports it, without a label.
    s = rows[(1, 7)]
    assert s.is_support and s.horizon_h is None and s.y == 0.0 and s.f_h2dep == 0.0
    # Flight 2 lands at 09:00, not before 09:00, so it does not support flight 3.
    assert (2, 9) not in rows
    now = rows[(2, 7)]
    assert now.f_inbound == 0.2 and now.f_turnaround == 0.5 and now.f_is_first == 0.0 and now.f_distance == 1.0
    before = rows[(2, 6)]
    assert before.f_turnaround == 0.0 and before.f_inbound == 0.2 and before.f_legs == 1 / 6
    edges = snapshots.flight_rotation(rot, ap, df)
    assert as_set(edges, "snapshot_time", "src_flight_id", "dst_flight_id") == {(ts("2022-01-01T07:00"), 1, 2)}
    assert as_set(snapshots.arrives_at(table), "flight_id", "airport") == {(2, "C"), (3, "A")}
    weights = {(r.flight_id, r.snapshot_time.hour): r.edge_weight for r in snapshots.departs_from(table, priors.airport_hour_state(df), pr).collect()}
    assert weights[(2, 7)] == 1.0 and weights[(2, 6)] == 0.0


def test_landed_only_hides_the_inbound_until_it_is_in(spark):
    df = flights(spark, [
        dict(flight_id=1, Tail_Number="N1", ORIGIN="A", DEST="B", dep=day("05:00"), arr=day("06:30"), ArrDelay=60.0, DepDelay=1.0),
        dict(flight_id=2, Tail_Number="N1", ORIGIN="B", DEST="C", dep=day("08:15"), arr=day("09:00"), ArrDelay=40.0, DepDelay=1.0),
    ])
    _, _, _, table = _tables(spark, df, landed_only=True)
    got = {r.snapshot_time.hour: r.f_inbound for r in table.where("flight_id = 2").collect()}
    assert got[6] == 0.0 and got[7] == 0.2 and got[8] == 0.2


def test_traffic_and_forecast(spark):
    df = flights(spark, [dict(flight_id=i, Tail_Number=f"N{i}", ORIGIN=o, DEST="B", dep=day(t), arr=day(a)) for i, (o, t, a) in enumerate(
        [("A", "00:10", "01:00"), ("A", "01:10", "02:10"), ("A", "03:10", "04:00"), ("A", "06:10", "07:00"), ("A", "07:10", "08:00")])])
    got = {(r.airport, r.snapshot_time.hour): r for r in priors.traffic(df).collect()}
    a = got[("A", 0)]
    assert (a.dep_1h, a.dep_3h, a.dep_6h) == (1, 2, 3)
    assert (got[("B", 0)].arr_1h, got[("B", 0)].arr_3h) == (1, 2)
    assert ("A", 2) not in got                                 # no departure anywhere in that hour
    climate = spark.createDataFrame([("A", 1, 2, 5.0, 1.0, 9.0)], "airport string, hour_of_day int, month int, wind double, precip double, vis double")
    got = {(r.hour_of_day, r.month): (r.wind_3h, r.wind_6h) for r in priors.forecast_proxy(climate).collect()}
    assert got == {(22, 1): (5.0, 0.0), (19, 1): (0.0, 5.0)}    # past midnight belongs to the next month
    kept = {(r.hour_of_day, r.month) for r in priors.forecast_proxy(climate, keep_month=True).collect()}
    assert kept == {(22, 2), (19, 2)}


def test_route_prior_falls_back(spark):
    rows = [dict(flight_id=i, Tail_Number="N", ORIGIN="A", DEST="B", dep=f"2022-01-0{3 + i % 2} 10:00", arr=day("12:00"), DepDelay=float(i)) for i in range(12)]
    rows += [dict(flight_id=20, ORIGIN="A", DEST="B", dep="2022-01-05 11:00", arr=day("12:00"), DepDelay=50.0), dict(flight_id=21, ORIGIN="X", DEST="Y", dep="2022-01-05 11:00", arr=day("12:00"), DepDelay=None)]
    df = flights(spark, rows)
    out = {r.flight_id: (r.hist_avg, r.hist_std) for r in priors.with_route_prior(df, priors.route_stats(df, min_fine=6, min_hour=5), priors.global_stats(df)).collect()}
    assert out[0][0] == 5.0 and out[1][0] == 6.0               # own weekday
    assert abs(out[20][0] - (66 + 50) / 13) < 1e-9             # route only: one flight in that hour
    assert abs(out[21][0] - (66 + 50) / 13) < 1e-9             # unknown route: overall mean
    one = flights(spark, [dict(flight_id=1, ORIGIN="A", DEST="B", dep=day("10:00"), arr=day("11:00"), DepDelay=3.0)])
    assert priors.route_stats(one, min_fine=1, min_hour=1).orderBy("grain").select("hist_std").collect()[0][0] == 20.0

"""Joins along time against plain loops."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import as_set
from skyledger.functions import timejoin as T
from skyledger.operators import network, tracking
from test_plans import plan

ZERO = datetime(2022, 1, 1)


def at(minutes):
    return None if minutes is None else ZERO + timedelta(minutes=minutes)


def tables(spark, seed):
    rng = random.Random(seed)
    keys = ["A"] * 6 + ["B", "C", None]
    left = [(k, rng.choice(keys), rng.choice([None, *range(0, 4000, 7)])) for k in range(200)]
    right = [(rng.choice(keys), rng.choice([None, *range(-500, 4500, 11)]), rng.randrange(9)) for _ in range(150)]
    kinds = "id long, k string, t timestamp_ntz"
    return left, right, spark.createDataFrame([(i, k, at(t)) for i, k, t in left], kinds), spark.createDataFrame(
        [(k, at(t), v) for k, t, v in right], "k string, u timestamp_ntz, v long")


def plain(left, right, direction, keyed, within, strict):
    out = set()
    for i, k, t in left:
        best = None
        if t is not None and (k is not None or not keyed):
            rows = [(u, v) for rk, u, v in right if u is not None and (not keyed or rk == k)]
            rows = [r for r in rows if {"backward": r[0] <= t, "forward": r[0] >= t, "nearest": True}[direction]]
            rows = [r for r in rows if within is None or abs(r[0] - t) < within or (abs(r[0] - t) == within and not strict)]
            best = min(rows, key=lambda r: (abs(r[0] - t), r[0], r[1]), default=None)
        out.add((i, at(best[0]) if best else None, best[1] if best else None))
    return out


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("keyed, within, strict, slot", [(True, None, False, 3600), (True, 44, True, 600), (False, 11, False, 86400), (True, 22, False, 60)])
def test_nearest_row(spark, direction, keyed, within, strict, slot):
    left, right, l, r = tables(spark, slot)
    got = T.nearest_row(l, r, ["k"] if keyed else [], "t", "u", ["v"], direction=direction, within_s=within and within * 60, strict=strict, slot_s=slot)
    assert got.columns == ["id", "k", "t", "match"]
    assert as_set(got, "id", "match.u", "match.v") == plain(left, right, direction, keyed, within, strict) and got.count() == len(left)


def test_nearest_row_of_empty_tables(spark):
    _, _, l, r = tables(spark, 1)
    assert as_set(T.nearest_row(l, r.limit(0), ["k"], "t", "u", ["v"]), "match") == {(None,)}
    assert T.nearest_row(l.limit(0), r, ["k"], "t", "u", ["v"]).count() == 0
    with pytest.raises(ValueError):
        T.nearest_row(l, r, ["k"], "t", "u", ["v"], direction="sideways")


def spans(spark, seed, names):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        start = rng.choice([None, *range(0, 3000, 5)])
        length = rng.choice([0, -5, 1, 7, 60, 61, 119, 500, 20_000])
        rows.append((i, rng.choice(["A", "A", "A", "B", None]), start, None if start is None else start + length))
    df = spark.createDataFrame([(i, k, at(s), at(e)) for i, k, s, e in rows], f"{names[0]} long, k string, {names[1]} timestamp_ntz, {names[2]} timestamp_ntz")
    return rows, df


def test_points_in_intervals_of_any_length(spark):
    left, _, points, _ = tables(spark, 3)
    rows, df = spans(spark, 4, ("j", "s", "e"))
    got = T.points_in(points, df, ["k"], "t", "s", "e", base_s=600).select("id", "j").collect()
    expected = [(i, j) for i, k, t in left for j, rk, s, e in rows if k is not None and k == rk and None not in (t, s) and s <= t < e]
    assert sorted(map(tuple, got)) == sorted(expected) and len(expected) > 500


def test_overlapping_intervals_each_pair_once(spark):
    a, da = spans(spark, 5, ("i", "s", "e"))
    b, db = spans(spark, 6, ("j", "u", "v"))
    got = T.overlapping(da, db, ["k"], ("s", "e"), ("u", "v"), base_s=600).select("i", "j").collect()
    expected = [(i, j) for i, k, s, e in a for j, rk, u, v in b if k is not None and k == rk and None not in (s, u) and s < e and u < v and s < v and u < e]
    assert sorted(map(tuple, got)) == sorted(expected) and len(expected) > 500


def test_overlap_totals_without_pairs(spark):
    a, da = spans(spark, 5, ("i", "s", "e"))
    b, db = spans(spark, 6, ("j", "u", "v"))
    db = db.withColumn("m", F.when(F.col("j") % 7 > 0, F.col("j") % 50))  # repeated and null values
    found = T.overlapping(da, db, ["k"], ("s", "e"), ("u", "v"), totals="m")
    expected = {}
    for i, k, s, e in a:
        met = [j for j, rk, u, v in b if k is not None and k == rk and None not in (s, u) and s < e and u < v and s < v and u < e]
        if met:
            expected[i] = (len(met), sorted({j % 50 for j in met if j % 7})[:2])
    got = found.collect()
    assert {r.i: (r.n, r.least) for r in got} == expected and len(got) == len(expected) > 50
    assert found.columns == [*da.columns, "n", "least"]
    assert T.overlapping(da, db.limit(0), ["k"], ("s", "e"), ("u", "v"), totals="m").count() == 0


def test_no_pair_beyond_a_slot_and_no_loops(spark):
    _, _, l, r = tables(spark, 7)
    _, df = spans(spark, 8, ("j", "s", "e"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (T.nearest_row(l, r, ["k"], "t", "u", ["v"]), T.points_in(l, df, ["k"], "t", "s", "e")):
            assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_window_reaches_to_its_last_row(spark):
    """Spark works such a frame out anew for every row, which takes the square of the rows of a slot."""
    _, _, l, r = tables(spark, 7)
    for direction in ("backward", "forward", "nearest"):
        assert "unboundedfollowing" not in plan(T.nearest_row(l, r, ["k"], "t", "u", ["v"], direction=direction)).lower()


def test_pairs_of_points_and_intervals_are_dealt_to_many_tasks(spark):
    """Both sides are small in bytes here; a broadcast or merged partitions would leave all their pairs to a few tasks."""
    _, _, l, _ = tables(spark, 7)
    _, df = spans(spark, 8, ("j", "s", "e"))
    text = plan(T.points_in(l, df, ["k"], "t", "s", "e"))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text and text.count("REPARTITION_BY_NUM") == 2


def test_leads_at_irregular_snapshots(spark):
    fl = spark.createDataFrame([(1, at(600)), (2, at(605)), (3, None)], "flight_id long, dep_datetime timestamp_ntz")
    # 6 h, 3 h and 1 h before flight 1: minutes 240, 420, 540.
    snaps = spark.createDataFrame([(at(m),) for m in (206, 274, 400, 440, 505, 575)], "snapshot_time timestamp_ntz")
    got = as_set(tracking.snapshots_at_leads(fl, snaps), "flight_id", "lead_h", "snapshot_time")
    assert got == {(1, 6, at(206)), (1, 3, at(400)), (1, 1, None), (2, 6, at(274)), (2, 3, at(440)), (2, 1, at(575))}


def test_correlations_equal_the_dense_ones(spark):
    import numpy as np

    rng = random.Random(9)
    hours, airports = 40, ["A", "B.1", "C", "D", "E", "F", "flat", "zero", "half1", "half2"]
    x = np.zeros((hours, len(airports)))
    rows = []
    for h in range(hours):
        for n, a in enumerate(airports):
            seen = {"flat": True, "zero": h == 3, "half1": h < 20, "half2": h >= 20}.get(a, rng.random() < 0.6)
            if seen:
                x[h, n] = {"flat": 5.0, "zero": 0.0, "half1": 10.0 + h % 3, "half2": -8.0 - h % 2}.get(a, round(rng.gauss(0, 30)) + 3 * h)
                rows.append((at(60 * h), a, float(x[h, n])))
    df = spark.createDataFrame(rows, "dep_hour timestamp_ntz, airport string, delay double")
    expected = {(airports[i], airports[j]): np.corrcoef(x[:, i], x[:, j])[0, 1] for i in range(len(airports)) for j in range(i + 1, len(airports))
                if not {airports[i], airports[j]} & {"flat", "zero"}}
    for blocks in (1, 3, 64):
        got = {(r.a, r.b): r.r for r in network.correlations(df, blocks=blocks).collect()}
        assert got.keys() == expected.keys() and all(abs(got[p] - expected[p]) < 1e-9 for p in expected)
    assert expected["half1", "half2"] > 0.3  # no common hour, yet an edge
    assert network.correlations(df.limit(0)).count() == 0


def test_route_table_equals_the_two_tables(spark):
    from skyledger.operators import priors
    from skyledger.sources import testdata as td

    fl = td.flights(spark, "/root/testdata/sf0.001")
    gaps = fl.withColumn("dep_datetime", F.when(F.col("flight_id") % 7 > 0, F.col("dep_datetime"))).withColumn("DEST", F.when(F.col("flight_id") % 5 > 0, F.col("DEST")))
    for rows in (fl, gaps):
        table = priors.route_table(rows, min_fine=2, min_hour=2)
        cols = ["ORIGIN", "DEST", "grain", "dep_hour", "dow", "n", F.round("hist_avg", 9), F.round("hist_std", 9)]
        assert as_set(table.where("grain > 0"), *cols) == as_set(priors.route_stats(rows, min_fine=2, min_hour=2), *cols)
        whole = priors.global_stats(rows).head()
        got = table.where("grain = 0").head()
        assert abs(got.hist_avg - whole.global_mean) < 1e-9 and abs(got.hist_std - whole.global_std) < 1e-9

import json

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from helpers import as_set, flights, ts
from skyledger.functions.expr import signed_expm1, signed_log1p
from skyledger.operators import congestion, evaluate, learn, network, quality, replay, tracking
from skyledger.sources import sinks


def log(spark, rows):
    df = spark.createDataFrame(rows, "flight_id long, snap_idx int, horizon_h int, pred double, severe_prob double, actual double")
    return evaluate.with_errors(df)


def test_sweep_counts(spark):
    p = log(spark, [(1, 0, 6, 130.0, 0.5, 120.0), (2, 0, 6, 10.0, 0.7, 10.0), (3, 0, 0, 10.0, 0.49, 500.0), (4, 0, 0, 1.0, 0.1, None)])
    got = {r.threshold: r for r in evaluate.sweep(p, [0.5, 0.6, 0.9]).collect()}
    assert (got[0.5].tp, got[0.5].fp, got[0.5].fn) == (1, 1, 1)      # the threshold itself is a hit
    assert (got[0.6].tp, got[0.6].fp, got[0.6].precision) == (0, 1, 0.0)
    assert (got[0.9].pred_pos, got[0.9].precision, got[0.9].recall) == (0, 0.0, 0.0)
    for r in got.values():
        assert r.tp + r.fp == r.pred_pos and r.tp + r.fn == r.actual_pos
    six = {r.threshold: r.actual_pos for r in evaluate.sweep(p, [0.5], horizon=6).collect()}
    assert six == {0.5: 1}


def test_best_threshold_prefers_valid_rows(spark):
    t = spark.createDataFrame([(0.9, 1.0, 0.01, 5), (0.5, 0.6, 0.5, 200), (0.6, 0.6, 0.5, 200)], "threshold double, precision double, recall double, pred_pos long")
    assert evaluate.best_threshold(t).head().threshold == 0.5
    assert evaluate.best_threshold(t, min_pred_pos=1000).head().threshold == 0.9


def test_detection_and_composite(spark):
    p = log(spark, [(1, 0, 6, 130.0, 0.6, 150.0), (2, 0, 1, 10.0, 0.2, 150.0), (3, 0, 6, 140.0, 0.1, 0.0)])
    d = {(r.scope, r.rule): (r.tp, r.fp, r.fn) for r in evaluate.detection(p).collect()}
    assert d[("all", "regression")] == (1, 1, 1) and d[("6h", "regression")] == (1, 1, 0) and d[("all", "classifier")] == (1, 0, 1)
    c = evaluate.checkpoint_score(p).head()
    assert c.mae_6h == 80.0 and c.mae_1h == 140.0 and c.mae_3h == 0.0 and c.composite == pytest.approx(0.5 * 80 + 0.15 * 140)


def test_trajectory_and_windows(spark):
    p = log(spark, [(1, 0, 6, 0.0, 0.0, 10.0), (1, 1, 3, 30.0, 0.0, 10.0)]).withColumn(
        "snapshot_time", F.lit("2022-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("snap_idx")))
    r = evaluate.trajectory(p).head()
    assert r.steps == 1 and r.improve_loss == 10.0 and r.jump_loss == 20.0 and r.trajectory_loss == 14.0
    s = spark.createDataFrame([("t", i, float(i)) for i in range(5)] + [("v", 0, 7.0)], "split string, snap_idx int, tail_score double")
    got = as_set(evaluate.window_scores(s, 3), "split", "start", "window_score")
    assert got == {("t", 0, 3.0), ("t", 1, 6.0), ("t", 2, 9.0), ("v", 0, 7.0)}
    assert {r.split for r in evaluate.sample_window(evaluate.window_scores(s, 3)).collect()} == {"t", "v"}


def test_append_comparison(spark, tmp_path):
    p = log(spark, [(1, 0, 6, 130.0, 0.6, 150.0)])
    path = str(tmp_path / "comparison")
    sinks.append_comparison(evaluate.comparison_row(p, checkpoint="a", split="val", with_classifier=False), path)
    sinks.append_comparison(evaluate.comparison_row(p, checkpoint="b", split="val"), path)
    got = {r.checkpoint: r.severe_cls_precision for r in spark.read.parquet(path).collect()}
    assert got == {"a": None, "b": 1.0}


def test_nearest_snapshot_ties_go_earlier(spark):
    df = spark.sql("select timestamp_ntz'2022-01-01 10:30:00' a, timestamp_ntz'2022-01-01 10:31:00' b")
    r = df.select(tracking.nearest_snapshot("a", 6).alias("a"), tracking.nearest_snapshot("b", 6).alias("b")).head()
    assert r.a == ts("2022-01-01T04:00") and r.b == ts("2022-01-01T05:00")


def test_natural_key_duplicates(spark):
    rows = [dict(flight_id=i, ORIGIN="A", DEST="B", dep="2022-01-01 10:00", arr="2022-01-01 11:00", ArrDelay=float(i)) for i in (1, 2)]
    df = flights(spark, rows)
    assert tracking.actuals_by_natural_key(df.where("flight_id = 1"), df).count() == 2
    assert tracking.actuals_by_natural_key(df.where("flight_id = 1"), df, dedupe=True).collect()[0].actual_arr_delay == 2.0


def test_congestion_edges(spark):
    rows = []
    for h in range(4):
        for k in range(6):
            rows.append(dict(flight_id=len(rows), ORIGIN="A", DEST="B" if k % 2 else "C", dep=f"2022-01-01 {h:02d}:{k:02d}", arr="2022-01-01 23:00", TaxiOut=60.0 if h == 0 else 10.0))
    df = flights(spark, rows)
    e = congestion.congestion_edges(df, min_pair=12, hubs=1, z=1.3, min_hours=1)
    by = {}
    for r in e.collect():
        by.setdefault(r.sub_type, set()).add((r.src_airport, r.dst_airport))
    assert by["taxi_anomaly"] == {("A", "B"), ("B", "A"), ("A", "C"), ("C", "A")}
    assert by["volume"] == {("A", "B"), ("A", "C")} and by["hub_spoke"] == {("A", "B"), ("A", "C")}
    assert e.where("sub_type = 'volume' and taxi_mean is not null").count() == 0
    zeros = congestion.congestion_edges(df, min_pair=12, hubs=1, min_hours=1, reference_compat=True)
    assert zeros.where("sub_type = 'volume' and taxi_mean = 0").count() == 2


def test_network_counts_missing_hours_as_zero_and_drops_constants(spark):
    rows, pattern = [], {"A": [10, 0, 20, 0], "B": [12, None, 18, None], "C": [5, 5, 5, 5]}
    for ap, delays in pattern.items():
        for h, v in enumerate(delays):
            if v is not None:
                rows.append(dict(flight_id=len(rows), ORIGIN=ap, DEST="Z", dep=f"2022-01-01 {h:02d}:00", arr="2022-01-01 23:00", DepDelay=float(v)))
    edges = network.network_edges(flights(spark, rows))
    import numpy as np

    r = round(float(np.corrcoef([10, 0, 20, 0], [12, 0, 18, 0])[0, 1]), 4)
    assert as_set(edges, "src_airport", "dst_airport", "correlation") == {("A", "B", r), ("B", "A", r)}


def test_quality_statuses(spark):
    df = flights(spark, [dict(flight_id=1, Tail_Number="N1", ORIGIN="A", DEST="B", dep="2022-01-01 10:00", arr="2022-01-01 12:00", DepDelay=1.0, ArrDelay=None)])
    got = {r.name: r.status for r in quality.basics(df, rows=(0, 10), years=(2022, 2022)).collect()}
    assert got["Row count reasonable"] == "pass" and got["Null rate ArrDelay"] == "fail" and got["Null rate DepDelay"] == "pass"
    expected = spark.createDataFrame([("A",), ("B",), ("Q",)], "airport string")
    got = {r.name: r.status for r in quality.airports(df, expected, min_rows=0, min_per_airport=0).collect()}
    assert got["All expected airports appear as origins"] == "fail"
    s = quality.summary(quality.delays(df)).head()
    assert s.total == 6 and s.passed + s.failed + s.warned == 6


def test_artifacts(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "rotation_edges"))
    got = {r.name: r.status for r in quality.artifacts(spark, str(tmp_path), {"rotation_edges": 5, "network_edges": 1}).collect()}
    assert got == {"rotation_edges has enough rows": "pass", "network_edges exists": "fail"}
    (tmp_path / "wx").mkdir()
    for n in ("ATL_2020.csv", "ATL_2021.csv", "odd.csv"):
        (tmp_path / "wx" / n).write_text("x\n")
    m = quality.weather_matrix(spark, str(tmp_path / "wx")).collect()
    assert m[0].airport == "ATL" and m[0]["2020"] and m[0]["2021"] and quality.misnamed_files(spark, str(tmp_path / "wx")).count() == 1


def test_replay_bundle(spark, tmp_path):
    fl = flights(spark, [dict(flight_id=i, Tail_Number=f"N{i}", ORIGIN="A", DEST="B", dep="2022-01-01 10:00", arr="2022-01-01 12:00", Operating_Airline="XX") for i in (1, 2)])
    p = log(spark, [(1, 0, 6, 130.0, 0.6, 150.0), (2, 0, 6, 10.0, 0.2, 150.0), (1, 1, 3, 1.0, 0.61, 2.0), (9, 0, 6, 1.0, 1.0, 1.0)])
    snaps = spark.sql("select * from values (0, timestamp_ntz'2022-01-01 04:00:00'), (1, timestamp_ntz'2022-01-01 07:00:00') as t(snap_idx, snapshot_time)")
    coords = spark.createDataFrame([("A", 1.0, 2.0), ("B", 3.0, 4.0)], "airport string, lat double, lon double")
    table = replay.day(p, fl, snaps, coords, "2022-01-01")
    assert len(table.columns) == 34 and table.count() == 3
    got = {(r.flight_id, r.snap_idx): r.alert_result for r in table.collect()}
    assert got == {(1, 0): "TP", (2, 0): "FN", (1, 1): "FP"}
    replay.write_day(table, str(tmp_path / "day"))
    assert spark.read.parquet(str(tmp_path / "day")).count() == 3
    replay.write_bundle(table, str(tmp_path / "bundle"), "2022-01-01", "val", 0.6)
    doc = json.loads(spark.read.text(str(tmp_path / "bundle" / "meta")).head()[0])
    assert doc["meta"]["rows"] == 3 and doc["meta"]["airportCoords"] == {"A": [1.0, 2.0], "B": [3.0, 4.0]}
    assert doc["snapshotTimes"] == ["2022-01-01 04:00", "2022-01-01 07:00"] and doc["snapshotSummary"][0]["severeActuals"] == 2
    assert spark.read.json(str(tmp_path / "bundle" / "rows")).count() == 3


def test_reranker_ranks_and_is_repeatable(spark):
    n = F.col("id")
    base = spark.range(4000).select(
        n.alias("flight_id"), (n % 40).cast("int").alias("snap_idx"), F.lit(6).alias("horizon_h"), F.when(n % 9 == 0, 150.0).otherwise((n % 100).cast("double")).alias("pred"),
        (F.when(n % 9 == 0, 0.6).otherwise(0.1) + (n % 10) / 40).alias("severe_prob"), F.when(n % 10 == 0, 200.0).when(n % 9 == 0, 180.0).otherwise(5.0).alias("actual"))
    pred = evaluate.with_errors(base)
    lookup = spark.range(4000).select(n.alias("flight_id"), F.lit("A").alias("ORIGIN"), F.when(n % 10 == 0, "HARD").otherwise("EASY").alias("DEST"), F.lit("XX").alias("Operating_Airline"),
                                      F.lit("2022-01-01 10:00").cast("timestamp_ntz").alias("dep_datetime"))
    model = learn.fit_reranker(pred, lookup, keep_negatives=0.5, min_pred_pos=10, max_iter=20)
    scored = learn.rerank(model, pred, lookup)
    assert scored.count() == 4000
    rep = learn.report(scored, model).head()
    assert rep.test_precision > 0.9 and rep.test_recall > 0.5
    again = {r.flight_id for r in learn.training_sample(pred, keep_negatives=0.1).collect()}
    moved = {r.flight_id for r in learn.training_sample(pred.repartition(7), keep_negatives=0.1).collect()}
    assert again == moved


def test_sample_is_bounded_when_severe_rows_pass_the_limit(spark):
    pred = spark.range(4000).select(
        F.col("id").alias("flight_id"), F.lit(1).alias("snap_idx"), F.lit(6).alias("horizon_h"), F.when(F.col("id") < 3000, 900.0).otherwise(0.0).alias("actual"))
    for limit in (200, 2000):
        n = {r.target_severe: r["count"] for r in learn.training_sample(pred, keep_negatives=0.5, max_rows=limit).groupBy("target_severe").count().collect()}
        assert 0.7 * limit < n[0] + n[1] < 1.3 * limit and min(n.values()) > 0.2 * min(limit, 1000)


def test_window_sample_does_not_depend_on_partitions(spark):
    windows = spark.range(100).select(F.lit("a").alias("split"), F.col("id").alias("start"), (F.col("id") % 7).cast("double").alias("window_score"))
    got = {evaluate.sample_window(windows.repartition(n)).first().start for n in (1, 2, 3, 7)}
    assert len(got) == 1


def test_forecaster_equals_spark_ml_in_few_passes(spark):
    """The fit of the two heads, against LinearRegression and LogisticRegression, which take a hundred jobs for it."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1000)) / 1000.0
    rows = spark.range(6000).select(
        F.col("id").alias("flight_id"), (F.col("id") % 7).cast("int").alias("snap_idx"), F.lit(None).cast("timestamp_ntz").alias("snapshot_time"),
        F.when(F.col("id") % 11 > 0, F.lit(6)).alias("horizon_h"), u(1).alias("f_a"), F.when(F.col("id") % 5 > 0, u(2) * 3).alias("f_b"), F.lit(0.0).alias("f_c"),
        (u(1) * 400 + u(3) * 500 - 200).alias("y")).repartition(5)
    names = ["f_a", "f_b", "f_c"]
    spark.sparkContext.setJobGroup("forecaster", "fit")
    model = learn.fit_forecaster(rows, names)
    spark.sparkContext.setJobGroup("other", "other")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("forecaster")) <= 30
    assert model.constants == {720.0: 0.0} and sorted(model.classifiers) == [0.0, 15.0, 60.0, 120.0, 240.0]
    got = {r.flight_id: r for r in learn.forecast(model, rows).collect()}
    data = VectorAssembler(inputCols=names, outputCol="features").transform(
        rows.where("horizon_h is not null").na.fill(0.0, names).withColumn("z", signed_log1p("y")))
    due = LinearRegression(labelCol="z", regParam=1e-3).fit(data).transform(data).select("flight_id", signed_expm1("prediction").alias("pred")).collect()
    assert len(due) == len(got) and all(abs(got[r.flight_id].pred - r.pred) < 1e-6 for r in due)
    for t, name in ((0.0, "p_ge_0"), (120.0, "p_ge_120"), (240.0, "p_ge_240")):
        fit = LogisticRegression(labelCol="l", regParam=1e-4, maxIter=200, tol=1e-10).fit(data.withColumn("l", (F.col("y") >= t).cast("double")))
        due = fit.transform(data).select("flight_id", vector_to_array("probability")[1].alias("p")).collect()
        assert all(abs(got[r.flight_id][name] - r.p) < 1e-4 for r in due)
    with pytest.raises(ValueError):
        learn.fit_forecaster(rows.limit(0), names)

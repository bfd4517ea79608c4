"""All jobs in a row, from CSV files to the exported replay."""
import json
import random

from pyspark.sql import functions as F

from skyledger.plans import jobs


def write_inputs(folder):
    rng = random.Random(7)
    airports = ["ATL", "BOS", "JFK", "LGA"]
    head = "FlightDate,Operating_Airline,Tail_Number,Origin,Dest,DepDelay,ArrDelay,TaxiOut,TaxiIn,AirTime,Distance,DepTime,ArrTime,Cancelled,Diverted"
    lines = [head]
    for d in range(1, 13):
        for tail in range(8):
            at, hour = airports[tail % 4], 5
            for _ in range(4):
                to = rng.choice([a for a in airports if a != at])
                late = rng.choice([-5, 0, 10, 30, 130, 260])
                lines.append(f"2022-01-{d:02d},C{tail % 3},N{tail},{at},{to},{late},{late + rng.randint(-5, 5)},{rng.randint(8, 40)},5,60,500,{hour}15,{hour + 1}45,False,False")
                at, hour = to, hour + 3
    (folder / "flights_2022.csv").write_text("\n".join(lines))
    wx = folder / "wx"
    wx.mkdir()
    place = {"ATL": (33.6, -84.4), "BOS": (42.4, -71.0), "JFK": (40.64, -73.78), "LGA": (40.78, -73.87)}
    for a, (lat, lon) in place.items():
        rows = ["datetime,latitude,longitude,elevation_m,wind_speed_ms,wind_gust_ms,visibility_m,precip_depth_mm,sea_level_pressure_hpa,ceiling_m,sky_cover_oktas,temp_c"]
        rows += [f"2022-01-{d:02d} {h:02d}:10:00,{lat},{lon},10,{h % 9},{h % 9 + 2},9000,{h % 3},1010,2000,4,5" for d in range(1, 13) for h in range(24)]
        (wx / f"{a}_2022.csv").write_text("\n".join(rows))


def test_files_to_replay(spark, tmp_path):
    write_inputs(tmp_path)
    out = str(tmp_path / "out")
    early = F.col("dep_datetime") < F.lit("2022-01-07").cast("timestamp_ntz")
    jobs.ingest_flights(spark, [str(tmp_path / "flights_2022.csv"), str(tmp_path / "missing.csv")], out)
    jobs.build_weather(spark, str(tmp_path / "wx"), out)
    jobs.build_rotation(spark, out)
    jobs.build_congestion(spark, out, min_pair=2, hubs=2, min_hours=1)
    jobs.build_snapshots(spark, out, is_train=early, hubs=2, min_fine=2, min_hour=2, min_r=0.0)
    t = F.col("snapshot_time")
    cut = F.lit("2022-01-07").cast("timestamp_ntz")
    jobs.build_predictions(spark, out, is_train=t < cut, max_iter=10)
    jobs.evaluate_predictions(spark, out, checkpoint="lr", split="val")
    later = F.lit("2022-01-10").cast("timestamp_ntz")
    jobs.rerank_predictions(spark, out, is_train=t < later, keep_negatives=1.0, min_pred_pos=1, max_iter=10)
    jobs.export_replay(spark, out, "2022-01-10")

    read = lambda name: spark.read.parquet(f"{out}/{name}")
    n = 12 * 8 * 4
    assert read("flights").count() == n and read("weather_node_features").count() == n
    assert read("flights").agg(F.count_distinct("flight_id"), F.max("flight_id")).head()[:] == (n, n - 1)
    assert [(r.src_airport, r.dst_airport) for r in read("weather_edges").collect()] == [("JFK", "LGA")]
    # Legs are 90 minutes apart on one day and start again elsewhere the next.
    assert read("rotation_edges").count() >= 12 * 8 * 3
    rows = read("flight_snapshots")
    assert rows.where("not is_support").groupBy("flight_id").count().agg(F.max("count")).head()[0] == 8
    assert rows.select(F.max("f_inbound"), F.min("f_hist_avg")).head()[0] > 0
    assert read("airport_snapshots").groupBy("snapshot_time").count().agg(F.min("count"), F.max("count")).head()[:] == (4, 4)
    assert read("departs_from_edges").count() == rows.count()
    assert jobs.dynamic_congestion(spark, out, "2022-01-10").count() > 0
    assert read("predictions").where("pred is null or severe_prob is null").count() == 0
    assert read("model_comparison").count() == 1 and read("reranked").count() > 0
    doc = json.loads(spark.read.text(f"{out}/replay_bundle/val_2022-01-10/meta").head()[0])
    assert doc["meta"]["rows"] == read("replay_days").count() > 0
    status = {r.name: r.status for r in jobs.check_build(spark, out, rotation_edges=1, network_edges=1, nothing=1).collect()}
    assert status["rotation_edges has enough rows"] == "pass" and status["nothing exists"] == "fail"
    assert status["Raw and enriched row counts equal"] == "pass"

import gzip

import pytest
from pyspark.sql import functions as F

from helpers import as_set, flights
from skyledger.operators import clean, weather
from skyledger.sources import flights as ff, sinks, weather as ws
from skyledger.sources.schemas import FLIGHTS


def test_clean_yearly(spark, tmp_path):
    (tmp_path / "a_2018.csv").write_text(
        "FlightDate, Operating_Airline ,Tail_Number,Origin,Dest,DepDelay,ArrDelay,DepTime,ArrTime,Cancelled,Diverted,\n"
        "2018-01-01,AA,N1,ATL,BOS,5,x,2350,10,False,False,\n"
        "2018-01-01,AA,N1,ATL,BOS,5,3,1000,1100,True,False,\n"
        "2018-01-01,AA,UNKNOW,ATL,BOS,5,3,1000,1100,False,False,\n"
        "2018-01-01,AA,N2,ATL,,5,3,1000,1100,False,False,\n"
        "2018-01-01,AA,N3,ATL,BOS,5,3,2400,1100,,,\n")
    (tmp_path / "a_2019.csv").write_text(
        "Tail_Number,FlightDate,Origin,Dest,DepTime,ArrTime\nN9,2019-05-05,A,B,900,1000\n")
    raw = ff.read_csv_files(spark, [str(tmp_path / "a_2018.csv"), str(tmp_path / "a_2019.csv"), str(tmp_path / "a_2020.csv")])
    out = {r.Tail_Number: r for r in clean.flights(raw).collect()}
    assert set(out) == {"N1", "N3", "N9"}
    assert str(out["N1"].dep_datetime) == "2018-01-01 23:50:00" and str(out["N1"].arr_datetime) == "2018-01-02 00:10:00"
    assert out["N1"].ArrDelay is None and out["N1"].DepDelay == 5.0
    assert str(out["N3"].dep_datetime) == "2018-01-01 00:00:00"
    assert out["N9"].Year == 2019 and out["N9"].Operating_Airline is None


def test_monthly_variant(spark):
    raw = spark.createDataFrame([
        ("2018-01-01", "AA", "N1", "1", "A", "B", "2400", "0030", "4", "3", "0", "0", "7"),
        ("2018-01-01", "AA", "N2", "2", "A", "B", "1000", "1100", "4", "3", "1", "0", "7"),
        ("2018-01-01", "AA", "N3", "3", "A", "B", "1000", "1100", "4", "3", "0", "1", "7"),
    ], ["FL_DATE", "UNIQUE_CARRIER", "TAIL_NUM", "FL_NUM", "ORIGIN", "DEST", "DEP_TIME", "ARR_TIME", "DEP_DELAY", "ARR_DELAY", "CANCELLED", "DIVERTED", "CARRIER_DELAY"])
    out = {r.Tail_Number: r for r in clean.flights_monthly(raw).collect()}
    assert set(out) == {"N1", "N3"}
    assert str(out["N1"].dep_datetime) == "2018-01-01 23:00:00" and str(out["N1"].arr_datetime) == "2018-01-02 00:30:00"
    assert out["N1"].CarrierDelay == 7.0


def test_flag_rules(spark):
    raw = spark.createDataFrame([("a", 0.0, 0.0, "N"), ("b", 1.0, 0.0, "N"), ("c", None, 0.0, "N"), ("d", 0.0, 1.0, "N"), ("e", 0.0, 0.0, None)],
                                "k string, Cancelled double, Diverted double, Tail_Number string")
    keep = lambda rule: {r.k for r in clean.flown(raw, rule).collect()}
    assert keep("not_true") == {"a", "c", "e"}
    assert keep("zero_with_tail") == {"a"}
    assert keep("cancelled_only") == {"a", "c", "d", "e"}


def test_flight_ids_are_positions(spark):
    rows = [dict(flight_id=None, Tail_Number=f"N{i % 7}", ORIGIN="A", DEST="B", dep=f"2022-01-{1 + (i * 13) % 28:02d} {i % 24:02d}:00", arr="2022-02-01 00:00") for i in range(200)]
    got = clean.assign_flight_id(flights(spark, rows).drop("flight_id")).orderBy("flight_id").collect()
    assert [r.flight_id for r in got] == list(range(200))
    keys = [(r.dep_datetime, r.Tail_Number) for r in got]
    assert keys == sorted(keys)


def test_sources_and_sinks(spark, tmp_path):
    df = flights(spark, [dict(flight_id=1, Tail_Number="N1", ORIGIN="A", DEST="B", dep="2022-03-04 05:00", arr="2022-03-04 06:00")]).withColumn("Year", F.lit(2022))
    sinks.write_flights(df, str(tmp_path / "flights"))
    path = ff.first_available(spark, [str(tmp_path / "none"), str(tmp_path / "flights")])
    assert path.endswith("flights") and ff.read_flights(spark, path).count() == 1
    assert ff.read_or_empty(spark, str(tmp_path / "absent"), FLIGHTS).count() == 0
    with pytest.raises(FileNotFoundError):
        ff.first_available(spark, [str(tmp_path / "none")])
    (tmp_path / "f.csv").write_text("dep_datetime,ORIGIN\n04/03/2022 05:10,A\nbad,B\n")
    got = {r.ORIGIN: r.dep_datetime for r in ff.read_flights(spark, str(tmp_path / "f.csv")).collect()}
    assert str(got["A"]) == "2022-03-04 05:10:00" and got["B"] is None


def test_weather_files_and_aliases(spark, tmp_path):
    (tmp_path / "ATL_2020.csv").write_text("DateTime,Latitude,Longitude,WSPD,vis,prcp\n2020-01-01 00:10:00,33.6,-84.4,3.5,9000,\nnot a date,1,1,1,1,1\n")
    (tmp_path / "bos_2021.csc").write_text("datetime,wind_speed_ms,slp\n01/02/2021 10:00,4,1010\n")
    (tmp_path / "notes.csv").write_text("a,b\n1,2\n")
    got = {r.airport: r for r in ws.read_weather(spark, str(tmp_path)).collect()}
    assert set(got) == {"ATL", "BOS"}
    assert got["ATL"].wind_speed_ms == 3.5 and got["ATL"].visibility_m == 9000.0 and got["ATL"].precip_depth_mm is None and got["ATL"].file_year == 2020
    assert str(got["BOS"].datetime) == "2021-02-01 10:00:00" and got["BOS"].sea_level_pressure_hpa == 1010.0


RECORD = "0000722190138742020010112004+33640-084427FM-15+0315KATL V0203101N00515220001CN0160931N1+01005+00005101325"


def record(extra=""):
    line = ("0000" + "722190" + "13874" + "202001011200" + "4" + "+33640" + "-084427" + "FM-15" + "+0315" + "KATL " + "V020"
            + "310" + "1" + "N" + "0051" + "1" + "22000" + "1" + "C" + "N" + "016093" + "1" + "N" + "1" + "+0100" + "1" + "+0050" + "1" + "10132" + "1")
    return line + extra


def test_records_gzip(spark, tmp_path):
    path = tmp_path / "ATL_2020.gz"
    with gzip.open(path, "wt") as f:
        f.write(record("AA10100" + "9999" + "GF105" + "99") + "\n" + record().replace("0051", "9999") + "\nshort\n")
    rows = sorted(ws.read_records(spark, str(path)).collect(), key=lambda r: r.wind_speed_ms is None)
    assert len(rows) == 2
    r = rows[0]
    assert (r.airport, r.station_id, r.wban, r.latitude, r.longitude, r.elevation_m) == ("ATL", "722190", "13874", 33.64, -84.427, 315.0)
    assert (r.wind_speed_ms, r.temp_c, r.dewpoint_c, r.visibility_m, r.sea_level_pressure_hpa) == (5.1, 10.0, 5.0, 16093.0, 1013.2)
    assert r.relative_humidity_pct == pytest.approx(71.0, abs=0.2)
    assert r.precip_depth_mm == 10.0 and r.sky_cover_oktas == 5.0 and r.wind_gust_ms is None
    assert rows[1].wind_speed_ms is None


def test_station_candidates(spark):
    h = spark.createDataFrame([("1", " 00010 ", 0), ("1", "99999", 1), ("1", "00005", 2), ("2", "00007", 3)], "USAF string, WBAN string, at long")
    assert as_set(ws.station_candidates(h, "at"), "usaf", "rank", "wban") == {
        ("1", 0, "99999"), ("1", 1, "00010"), ("1", 2, "00005"), ("2", 0, "99999"), ("2", 1, "00007")}


def test_hourly_weather_nulls(spark):
    obs = spark.createDataFrame([("A", "2020-01-01 00:05", 1.0, None), ("A", "2020-01-01 00:55", 3.0, None), ("A", "2020-01-01 01:00", None, 2.0)],
                                "airport string, t string, wind_speed_ms double, precip_depth_mm double")
    obs = obs.withColumn("datetime", F.col("t").cast("timestamp_ntz"))
    for c in ("wind_gust_ms", "visibility_m", "sea_level_pressure_hpa", "ceiling_m", "sky_cover_oktas", "temp_c"):
        obs = obs.withColumn(c, F.lit(None).cast("double"))
    got = {r.obs_hour.hour: r for r in weather.hourly(obs).collect()}
    assert got[0].wind_speed_ms == 2.0 and got[0].precip_depth_mm == 0.0 and got[1].wind_speed_ms is None and got[1].precip_depth_mm == 2.0


def test_same_metro_needs_no_cross_join(spark):
    locs = spark.createDataFrame([("JFK", 40.639, -73.779), ("LGA", 40.777, -73.873), ("EWR", 40.692, -74.174), ("LAX", 33.943, -118.408),
                                  ("W", 0.0, 179.95), ("E", 0.0, -179.95), ("P", 89.99, 0.0), ("Q", 89.99, 180.0)], "airport string, lat double, lon double")
    edges = weather.same_metro(locs)
    assert as_set(edges, "src_airport", "dst_airport") == {("JFK", "LGA"), ("EWR", "JFK"), ("EWR", "LGA"), ("E", "W"), ("P", "Q")}
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (" in plan


def test_headers_need_no_job_whatever_the_number_of_files(spark, tmp_path):
    counts = []
    for n in (2, 12):
        folder = tmp_path / f"f{n}"
        folder.mkdir()
        for k in range(n):
            (folder / f"y {k}.csv").write_text(("a,b\n1,2\n" if k % 2 else "b,c\n3,4\n"))
        spark.sparkContext.setJobGroup(f"files-{n}", "")
        assert len(ff.headers(spark, [str(folder)])) == 2
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(f"files-{n}")
        df = ff.read_csv_files(spark, [str(folder / f"y {k}.csv") for k in range(n)])
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"files-{n}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert df.columns == ["b", "c", "a"] and df.count() == n and df.where("a = 1 and b = 2").count() == n // 2
    assert counts[0] == counts[1]

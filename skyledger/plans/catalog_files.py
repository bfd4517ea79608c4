"""Registered queries over files: tables derived from the events are written in the layouts that readers meet, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import clean, evaluate, learn, quality

from skyledger.plans.catalog import SQL, _pad, _predictions, _raw_yearly, query, record_lines
from skyledger.plans.oracle import tier
from skyledger.plans.staging import new_folder
from skyledger.sources import feeds, rejects, sinks, testdata as td
from skyledger.sources import flights as files
from skyledger.sources.schemas import OBSERVATION_FEED, PREDICTIONS, ROTATION
from skyledger.sources.weather import read_records, read_weather, station_candidates


def _inherit(name, wrap="SELECT * FROM ({sql})"):
    """The SQL of another query, which must come out of the files unchanged."""
    return wrap.format(sql=SQL[name])


@query(None)
def flights_from_csv(s, d):
    """Yearly files under two headers, in another order, with blanks in names and an unnamed column; one of the paths does not exist."""
    out, raw = new_folder(s, "csv"), _raw_yearly(s, d)
    first = raw.where("event_id % 2 = 0").select(*[F.col(c).alias(f" {c}") for c in raw.columns], F.lit("").alias("Unnamed: 12"))
    sinks.write_csv(first, f"{out}/a")
    sinks.write_csv(raw.where("event_id % 2 = 1").select(*reversed(raw.columns)), f"{out}/b")
    read = files.read_csv_files(s, [f"{out}/a", f"{out}/none", f"{out}/b"])
    return clean.flights(read).select(
        "FlightDate", "Operating_Airline", "Tail_Number", "ORIGIN", "DEST", "DepDelay", "ArrDelay",
        F.coalesce("DayOfWeek", F.weekday("FlightDate") + 1).alias("DayOfWeek"), "dep_datetime", "arr_datetime")


SQL["flights_from_csv"] = _inherit("flights_cleaned")


@query("SELECT flight_id, Tail_Number, ORIGIN, DEST, DepDelay, dep_datetime, FlightDate FROM v_flights")
def flights_by_format(s, d):
    """A table written as CSV with day-first times, found behind a missing one, and read by its ending; rotation edges were never written."""
    out = new_folder(s, "formats")
    day_first = td.flights(s, d).select("flight_id", "Tail_Number", "ORIGIN", "DEST", "DepDelay", F.date_format("dep_datetime", "d/M/yyyy H:mm").alias("dep_datetime"),
                                        F.date_format("FlightDate", "d/M/yyyy").alias("FlightDate"))
    sinks.write_csv(day_first, f"{out}/flights.csv")
    read = files.read_flights(s, files.first_available(s, [f"{out}/enriched.parquet", f"{out}/flights.csv"]))
    edges = files.read_or_empty(s, f"{out}/rotation", ROTATION)
    return read.select(F.col("flight_id").cast("long").alias("flight_id"), "Tail_Number", "ORIGIN", "DEST", F.col("DepDelay").cast("double").alias("DepDelay"),
                       "dep_datetime", "FlightDate").join(edges.select(F.col("leg1_flight_id").alias("flight_id")), "flight_id", "left_anti")


@query("SELECT flight_id, CAST(snap_idx AS INTEGER) AS snap_idx, CAST(horizon_h AS INTEGER) AS horizon_h, pred, severe_prob, actual, abs_err, sq_err FROM v_pred WHERE horizon_h = 6",
       "pred", "severe_prob", "actual", "abs_err", "sq_err")
def predictions_from_csv(s, d):
    out = new_folder(s, "predictions")
    sinks.write_csv(_predictions(s, d), f"{out}/log.csv")
    return files.read_predictions(s, f"{out}/log.csv").where("horizon_h = 6").select(*PREDICTIONS.names)


@query("SELECT flight_id, ORIGIN, DepDelay, \"Year\" FROM v_flights")
def flights_by_year(s, d):
    """Flights in folders by year, in departure order inside the files, and read back."""
    out = new_folder(s, "by-year")
    sinks.write_flights(td.flights(s, d), out)
    return s.read.parquet(out).select("flight_id", "ORIGIN", "DepDelay", "Year")


# ---------------------------------------------------------------- rejects

_ROW = """event_id || ',' || CASE WHEN event_id % 89 = 3 THEN 'not a day' ELSE strftime(ts, '%Y-%m-%d') END || ',' ||
  CASE WHEN event_id % 83 = 2 THEN 'late' ELSE CAST(event_id % 70 AS VARCHAR) END || CASE WHEN event_id % 97 = 5 THEN '' ELSE ',N' || user_id END"""


@query(f"""SELECT row, reason, dropped FROM (SELECT {_ROW} AS row, unnest(CASE WHEN event_id % 97 = 5 THEN ['number of values'] ELSE
    list_filter([CASE WHEN event_id % 89 = 3 THEN 'FlightDate: not readable' END, CASE WHEN event_id % 83 = 2 THEN 'DepDelay: not readable' END], lambda x: x IS NOT NULL) END) AS reason,
    event_id % 97 = 5 OR event_id % 89 = 3 AS dropped FROM events)""")
def csv_rejects(s, d):
    """Rows that are too short, have no date, or a delay that is no number, with the reason and whether the row was lost."""
    i, out = F.col("event_id"), new_folder(s, "rejects")
    line = F.concat(i.cast("string"), F.lit(","), F.when(i % 89 == 3, "not a day").otherwise(F.date_format("ts", "yyyy-MM-dd")), F.lit(","),
                    F.when(i % 83 == 2, "late").otherwise((i % 70).cast("string")),
                    F.when(i % 97 == 5, "").otherwise(F.concat(F.lit(",N"), F.col("user_id").cast("string"))))
    td.table(s, d, "events").select(line).write.text(f"{out}/raw")
    read = rejects.read_csv(s, f"{out}/raw", ["id", "FlightDate", "DepDelay", "Tail_Number"], {
        "FlightDate": F.try_to_timestamp("FlightDate", F.lit("yyyy-MM-dd")).isNotNull(), "DepDelay": F.col("DepDelay").try_cast("double").isNotNull()},
        ["FlightDate"], has_header=False)
    rejects.write(rejects.of_rows(read), f"{out}/rejects")
    return s.read.parquet(f"{out}/rejects").select("row", F.col("reason").cast("string").alias("reason"), "dropped")


@query("""SELECT 'record too short' AS reason, TRUE AS dropped, count(*) AS rows FROM events WHERE event_id % 19 = 0 HAVING count(*) > 0
  UNION ALL SELECT 'time not readable', TRUE, count(*) FROM events WHERE event_id % 19 <> 0 AND event_id % 23 = 0 HAVING count(*) > 0
  UNION ALL SELECT CASE WHEN event_id % 3 = 0 THEN 'empty' ELSE 'not the feed''s JSON' END, TRUE, count(*) FROM events WHERE event_id % 3 < 2 GROUP BY 1""")
def rejects_by_reason(s, d):
    """Station records and feed payloads that cannot be decoded, counted by reason."""
    lines = record_lines(s, d).withColumn("value", F.when(F.col("event_id") % 23 == 0, F.overlay("value", F.lit("xx"), 18)).otherwise(F.col("value")))
    i = F.col("event_id")
    payload = F.when(i % 3 == 0, " ").when(i % 3 == 1, F.lit('{"properties": [')).otherwise(F.lit('{"properties": {"windSpeed": {"value": 1.5}}}'))
    feed = td.table(s, d, "events").select("event_id", payload.alias("payload"))
    found = rejects.of_lines(lines.withColumn("file", F.lit("records"))).unionByName(rejects.of_payloads(feed, OBSERVATION_FEED, source="event_id"))
    return rejects.report(found)


# ---------------------------------------------------------------- station files

_DEW = "-(event_id % 400 + event_id % 60) / CAST(10 AS DOUBLE)"
_TEMP = "-(event_id % 400) / CAST(10 AS DOUBLE)"
_MAGNUS = "CAST(17.625 AS DOUBLE) * {v} / (CAST(243.04 AS DOUBLE) + {v})"


@query(f"""SELECT date_trunc('minute', ts) AS datetime, CAST(year(ts) AS INTEGER) AS year, CAST(minute(ts) AS INTEGER) AS minute, (event_id % 90000) / CAST(1000 AS DOUBLE) AS latitude,
    -(event_id % 99999) / CAST(1000 AS DOUBLE) AS longitude, CAST(182 AS DOUBLE) AS elevation_m, {_TEMP} AS temp_c, {_DEW} AS dewpoint_c,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 360 END * CAST(1 AS DOUBLE) AS wind_dir_deg,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 300) / CAST(10 AS DOUBLE) END AS wind_speed_ms, CASE WHEN event_id % 4 = 0 THEN (event_id % 500) / CAST(10 AS DOUBLE) END AS wind_gust_ms,
    CAST(NULL AS DOUBLE) AS sea_level_pressure_hpa, CAST(event_id % 16000 AS DOUBLE) AS visibility_m, CAST(NULL AS DOUBLE) AS ceiling_m, '722590' AS station_id, '03927' AS wban,
    CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 9 AS DOUBLE) END AS sky_cover_oktas, CASE WHEN event_id % 2 = 0 THEN (event_id % 9000) / CAST(10 AS DOUBLE) END AS precip_depth_mm,
    CAST(NULL AS DOUBLE) AS snow_depth_mm, round(100 * exp({_MAGNUS.format(v=f'({_DEW})')} - {_MAGNUS.format(v=f'({_TEMP})')}), 1) AS relative_humidity_pct
  FROM events WHERE event_id % 19 <> 0""", "latitude", "longitude", "temp_c", "dewpoint_c", "wind_dir_deg", "wind_speed_ms", "wind_gust_ms", "visibility_m", "precip_depth_mm", "relative_humidity_pct")
def records_from_gzip(s, d):
    """Compressed record files to all their fields."""
    out, i = new_folder(s, "records"), F.col("event_id")
    dew = F.concat(F.lit("-"), _pad(i % 400 + i % 60, 4))
    record_lines(s, d, dew).select("value").write.option("compression", "gzip").text(out)
    return read_records(s, out).select(
        "datetime", "year", "minute", "latitude", "longitude", "elevation_m", "temp_c", "dewpoint_c", "wind_dir_deg", "wind_speed_ms", "wind_gust_ms", "sea_level_pressure_hpa",
        "visibility_m", "ceiling_m", "station_id", "wban", "sky_cover_oktas", "precip_depth_mm", "snow_depth_mm",
        "relative_humidity_pct")


@query(f"""SELECT event_id, round(100 * exp({_MAGNUS.format(v='d')} - {_MAGNUS.format(v='t')}), 1) AS relative_humidity_pct FROM (
    SELECT event_id, (event_id % 400) / CAST(10 AS DOUBLE) AS t, (event_id % 400 - event_id % 60) / CAST(10 AS DOUBLE) AS d FROM events)""", "relative_humidity_pct")
def humidity(s, d):
    from skyledger.functions.expr import relative_humidity

    i = F.col("event_id")
    return td.table(s, d, "events").select("event_id", relative_humidity((i % 400) / F.lit(10.0), (i % 400 - i % 60) / F.lit(10.0)).alias("relative_humidity_pct"))


_CODE = "'Q' || chr(CAST(65 + key // 5 AS INTEGER)) || chr(CAST(65 + key % 5 AS INTEGER))"


def _station_files(s, d):
    """AIRPORT_YEAR.csv of every airport, half of them under older column names, one with the common misspelt ending."""
    out = new_folder(s, "stations")
    key = F.col("key")
    code = F.concat(F.lit("Q"), F.char(65 + F.floor(key / 5)), F.char(65 + key % 5))
    obs = td.weather(s, d).join(td.airports(s, d).select("airport", "key"), "airport").select(
        code.alias("code"), key.alias("half"), F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("DateTime"), "wind_speed_ms", "visibility_m", "precip_depth_mm")
    jvm, conf = s.sparkContext._jvm, s.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(out).getFileSystem(conf)
    for n, names in enumerate((["DateTime", "wind_speed_ms", "visibility_m", "precip_depth_mm"], ["Obs DateTime", "prcp", "wspd", "vis"])):
        part = obs.where(f"half % 2 = {n}")
        if n:
            part = part.select("code", F.col("DateTime").alias(names[0]), F.col("precip_depth_mm").alias("prcp"), F.col("wind_speed_ms").alias("wspd"), F.col("visibility_m").alias("vis"))
        part.select("code", *names).repartition("code").write.option("header", True).partitionBy("code").csv(f"{out}/parts{n}")
        for folder in fs.listStatus(path(f"{out}/parts{n}")):
            if folder.isDirectory():
                airport = folder.getPath().getName().partition("=")[2]
                [part_file] = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
                fs.mkdirs(path(f"{out}/all"))
                fs.rename(part_file, path(f"{out}/all/{airport}_2024.{'csc' if airport == 'QAA' else 'csv'}"))
    return f"{out}/all"


@query(f"""SELECT {_CODE} AS airport, CAST(2024 AS INTEGER) AS file_year, datetime, wind_speed_ms, visibility_m, precip_depth_mm FROM v_obs JOIN v_airports USING (airport)""",
       "wind_speed_ms", "visibility_m", "precip_depth_mm")
def weather_from_files(s, d):
    return read_weather(s, _station_files(s, d)).select("airport", "file_year", "datetime", "wind_speed_ms", "visibility_m", "precip_depth_mm")


@query(f"""SELECT DISTINCT {_CODE} AS airport, TRUE AS "2024" FROM v_obs JOIN v_airports USING (airport)""")
def weather_file_matrix(s, d):
    return quality.weather_matrix(s, _station_files(s, d))


@query("""SELECT usaf, row_number() OVER (PARTITION BY usaf ORDER BY place) - 1 AS rank, wban FROM (
    SELECT DISTINCT 'U' || user_id AS usaf, '99999' AS wban, -1 AS place FROM events
    UNION ALL SELECT 'U' || user_id, lpad(CAST(event_id % 50 AS VARCHAR), 5, '0'), event_id FROM events)""")
def station_history(s, d):
    history = td.table(s, d, "events").select(F.concat(F.lit(" U"), F.col("user_id").cast("string")).alias("USAF"), _pad(F.col("event_id") % 50, 5).alias("WBAN"), "event_id")
    return station_candidates(history, "event_id")


# ---------------------------------------------------------------- feeds, logs and artifacts


@query("""SELECT 'A' || (event_id % 25) AS dep_airport, 'x' || user_id AS icao24, CAST(floor(epoch(ts)) AS BIGINT) AS "firstSeen", CASE WHEN user_id % 3 = 0 THEN 'N' || user_id ELSE '' END AS Tail_Number
  FROM events WHERE floor(epoch(ts)) BETWEEN epoch(TIMESTAMP '2024-01-10 10:00:00') AND epoch(TIMESTAMP '2024-01-10 12:00:00')""")
def recent_departures(s, d):
    """Departures of the last two hours with the tail of known transponders."""
    ev = td.table(s, d, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    feed = ev.select(F.concat(F.lit("A"), (F.col("event_id") % 25).cast("string")).alias("dep_airport"), F.concat(F.lit("x"), F.col("user_id").cast("string")).alias("icao24"), at.alias("firstSeen"))
    registry = ev.where("user_id % 3 = 0").select(F.concat(F.lit("x"), F.col("user_id").cast("string")).alias("icao24"), F.concat(F.lit("N"), F.col("user_id").cast("string")).alias("registration")).distinct()
    return feeds.with_tail(feeds.recent_departures(feed, F.lit("2024-01-10 12:00:00").cast("timestamp")), registry).select("dep_airport", "icao24", "firstSeen", "Tail_Number")


@query(None)
def comparison_appended(s, d):
    """Two runs appended to one comparison table; the second knows no classifier."""
    out = new_folder(s, "comparison")
    sinks.append_comparison(evaluate.comparison_row(_predictions(s, d), checkpoint="first", split="all"), out)
    sinks.append_comparison(evaluate.comparison_row(_predictions(s, d), checkpoint="second", split="all").drop("severe_cls_precision", "severe_cls_recall"), out)
    return s.read.parquet(out)


SQL["comparison_appended"] = _inherit("model_comparison", """SELECT * REPLACE ('first' AS checkpoint) FROM ({sql}) UNION ALL
  SELECT * REPLACE ('second' AS checkpoint, CAST(NULL AS DOUBLE) AS severe_cls_precision, CAST(NULL AS DOUBLE) AS severe_cls_recall) FROM ({sql})""")


@query("""SELECT 'flights has enough rows' AS name, CASE WHEN count(*) >= 1000 THEN 'pass' ELSE 'fail' END AS status, count(*) || ' rows' AS detail FROM v_flights
  UNION ALL SELECT 'rotation has enough rows', CASE WHEN count(*) >= 100000000 THEN 'pass' ELSE 'fail' END, count(*) || ' rows' FROM v_rotation
  UNION ALL SELECT 'network exists', 'fail', 'not found'""")
def artifact_checks(s, d):
    from skyledger.operators.rotation import rotation_edges

    out = new_folder(s, "build")
    sinks.write_table(td.flights(s, d), f"{out}/flights")
    sinks.write_table(rotation_edges(td.flights(s, d)), f"{out}/rotation")
    found = quality.artifacts(s, out, {"flights": 1000, "rotation": 100_000_000, "network": 1})
    return found.select("name", "status", F.when(F.col("detail").startswith("not found"), "not found").otherwise(F.col("detail")).alias("detail"))


@query(f"""SELECT p.flight_id, p.snap_idx, p.horizon_h, p.pred, abs(pred) AS pred_abs, least(greatest(pred, -60), 720) AS pred_clip, severe_prob,
    greatest(pred - 120, 0) AS pred_minus_120, greatest(pred - 240, 0) AS pred_minus_240, greatest(pred - 720, 0) AS pred_minus_720, severe_prob * pred AS sev_x_pred,
    severe_prob * CAST(pred >= 120 AS INTEGER) AS sev_x_pred120, severe_prob * CAST(horizon_h = 6 AS INTEGER) AS sev_x_h6, CAST(CAST(pred >= 120 AS INTEGER) AS DOUBLE) AS pred_ge_120,
    CAST(CAST(pred >= 240 AS INTEGER) AS DOUBLE) AS pred_ge_240, CAST(CAST(pred >= 720 AS INTEGER) AS DOUBLE) AS pred_ge_720, CAST(hour(dep_datetime) AS DOUBLE) AS dep_hour,
    CAST(isodow(dep_datetime) - 1 AS DOUBLE) AS dep_dow, CAST(month(dep_datetime) AS DOUBLE) AS dep_month, {tier('pred')} AS pred_bucket_idx, Operating_Airline, ORIGIN, DEST, ORIGIN || '_' || DEST AS route
  FROM v_pred p JOIN v_flights f ON f.flight_id = p.flight_id""", "pred", "pred_abs", "pred_clip", "severe_prob", "pred_minus_120", "pred_minus_240", "pred_minus_720", "sev_x_pred", "sev_x_pred120", "sev_x_h6")
def reranker_features(s, d):
    """All features of the reranker."""
    found = learn.rerank_features(_predictions(s, d), clean.flight_lookup(td.flights(s, d)))
    return found.select("flight_id", "snap_idx", *learn.NUMERIC, *learn.CATEGORICAL)



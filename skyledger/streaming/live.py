"""Live tracking: stateful aggregates over landed feeds, and the per-cycle feature tables.

Stateful functions take and return streaming DataFrames and work on batch ones too.
Per-cycle functions are stream-static joins and expressions for `foreachBatch`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.expr import (
    clip, cyclic, delay_cause, hours_between, predicted_status,
)
from skyledger.operators.clean import between_airports
from skyledger.streaming.tables import batch_writer, current  # noqa: F401

REFRESH = "30 minutes"
LATE_BY = "1 day"  # default of `late_by`: rows later than this behind the newest one are dropped by the stateful operators

# Origins treated as hubs in live flight rows.
LIVE_HUBS = ["ATL", "BOS", "CLT", "DEN", "DFW", "EWR", "IAD", "IAH", "JFK", "LAX", "LGA", "MIA", "ORD", "SFO"]


def read_folder(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "json", *, files: str | None = None,
                max_files: int | None = None, nested: bool = False) -> DataFrame:
    """Stream of the files that land in a folder, or anywhere under it."""
    reader = spark.readStream.format(fmt).schema(schema).option("recursiveFileLookup", nested)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def start(df: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str, *, mode: str = "update",
          once: bool = False, every: str = REFRESH):
    """Run `each_batch` every half hour (or another interval), or over what is there now and stop."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each_batch)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


append_to = batch_writer  # batches of an update-mode query are folded by key if `keys` are given


def late_rows(query) -> int:
    """Rows that the stateful operators of a streaming query have dropped as too late, as far as its progress is kept."""
    return sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in p["stateOperators"])


def progress(spark: SparkSession, query) -> DataFrame:
    """What a query reports of each batch and stateful operator: rows read, rows and bytes of state, rows let go and rows dropped as late."""
    rows = [(p["batchId"], p["numInputRows"], p.get("eventTime", {}).get("watermark"), k, o["operatorName"], o["numRowsTotal"], o.get("memoryUsedBytes"),
             o.get("numRowsRemoved"), o.get("numRowsDroppedByWatermark"))
            for p in query.recentProgress for k, o in enumerate(p["stateOperators"])]
    return spark.createDataFrame(rows, "batch long, input_rows long, watermark string, step int, operator string, state_rows long, "
                                       "state_bytes long, removed_rows long, late_rows long")


# ---------------------------------------------------------------- state over streams


def first_reports(movements: DataFrame, *, time: str = "event_time", late_by: str = LATE_BY) -> DataFrame:
    """Each flight once, however many polls repeat it."""
    return movements.withWatermark(time, late_by).dropDuplicatesWithinWatermark(["flight_number", "dep_scheduled"])


def landed_late(movements: DataFrame) -> DataFrame:
    return movements.where("flight_status = 'landed' and arr_delay_min > 0 and Tail_Number is not null and Tail_Number <> ''")


def tail_state(movements: DataFrame, *, time: str = "event_time", late_by: str = LATE_BY) -> DataFrame:
    """Per tail and UTC day: accumulated delay, late legs and the last delay.

    The day reset is the one-day window itself. The sums combine before the exchange,
    so a tail reported very often costs one state row.
    """
    return _by_tail_and_day(landed_late(movements).withWatermark(time, late_by), time)


def _by_tail_and_day(late: DataFrame, time: str) -> DataFrame:
    return late.groupBy(F.window(time, "1 day").alias("w"), "Tail_Number").agg(
        F.sum("arr_delay_min").alias("cumul"), F.count(F.lit(1)).alias("legs"),
        F.max_by("arr_delay_min", F.struct(time, "flight_number")).alias("immed"),
    ).select(F.to_date("w.start").alias("day"), "Tail_Number", "cumul", "legs", "immed")


def closed_tail_days(polls: DataFrame, *, time: str = "event_time", late_by: str = LATE_BY) -> DataFrame:
    """Tail state of finished days from a feed that repeats its reports, for append mode.

    Two stateful steps in one query: a landing is counted once however many polls repeat it, then added to
    its tail's day. The watermark follows the late landings alone: Spark applies the filter before it. A day is given out, once, when the watermark has passed its end,
    and both steps let go of what lies behind the watermark; a repeat that comes later still is dropped as late by the first.
    """
    landed = landed_late(polls.withWatermark(time, late_by))
    return _by_tail_and_day(landed.dropDuplicatesWithinWatermark(["flight_number", "dep_scheduled"]), time)


def hourly_departures(flights: DataFrame, *, time: str = "dep_datetime", late_by: str = LATE_BY) -> DataFrame:
    """Mean delay, taxi time and count per origin and hour."""
    return flights.withWatermark(time, late_by).groupBy(F.window(time, "1 hour").alias("w"), "ORIGIN").agg(
        F.avg("DepDelay").alias("avg_dep_delay"), F.avg("TaxiOut").alias("avg_taxi_out"), F.count("DepDelay").alias("dep_count"),
    ).select(F.col("w.start").alias("hour"), F.col("ORIGIN").alias("airport"), "avg_dep_delay", "avg_taxi_out", "dep_count")


def lookahead(flights: DataFrame, *, hours: int = 3, time: str = "dep_datetime", late_by: str = LATE_BY) -> DataFrame:
    """Departures in the `hours` full hours after each hour, as sliding windows over scheduled times."""
    return flights.withWatermark(time, late_by).groupBy(
        F.window(time, f"{hours} hours", "1 hour").alias("w"), "ORIGIN").agg(F.count(F.lit(1)).alias("departures")).select(
        (F.col("w.start") - F.expr("INTERVAL 1 HOUR")).alias("snapshot_time"), F.col("ORIGIN").alias("airport"), "departures")


# ---------------------------------------------------------------- per-cycle tables


def airport_features(
    airports: DataFrame, stats: DataFrame, weather: DataFrame, forecast: DataFrame, status: DataFrame, now: Column
) -> DataFrame:
    """Current state of every airport: history, weather, forecast, reported delay, time of day.

    Traffic load has no live source and is given its neutral value 0.5.
    """
    rows = airports.select("airport").join(stats, "airport", "left").join(weather, "airport", "left").join(
        forecast, "airport", "left").join(status.select("airport", "avg_delay_min"), "airport", "left")
    d = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    hs, hc = cyclic(F.hour(now), 24)
    ms, mc = cyclic(F.month(now), 12)
    return rows.select(
        "airport", d("is_hub", 0.0), d("hist_avg_dep_delay", 0.0), d("hist_avg_taxi_out", 0.0), d("hist_avg_arr_delay", 0.0),
        d("total_departures_norm", 0.0), F.coalesce("avg_delay_min", F.lit(0.0)).alias("avg_dep_delay"),
        F.lit(0.0).alias("avg_arr_delay"), F.coalesce("hist_avg_taxi_out", F.lit(19.0)).alias("avg_taxi_out"),
        F.lit(0.0).alias("avg_taxi_in"), F.lit(0.0).alias("dep_count"), F.lit(0.0).alias("arr_count"),
        F.coalesce("wind_speed_ms", F.lit(0.0)).alias("wind"), F.coalesce("visibility_m", F.lit(10000.0)).alias("vis"),
        F.coalesce("precip_mm", F.lit(0.0)).alias("precip"),
        *[F.lit(0.5).alias(f"load_{c}_{w}h") for w in (1, 3, 6) for c in ("dep", "arr")],
        *[F.coalesce(f"{c}_{a}h", F.lit(10000.0 if c == "vis" else 0.0)).alias(f"forecast_{c}_{a}h")
          for a in (3, 6) for c in ("wind", "precip", "vis")],
        hs.alias("hour_sin"), hc.alias("hour_cos"), ms.alias("month_sin"), mc.alias("month_cos"))


def flight_features(
    departures: DataFrame, airports: DataFrame, tails: DataFrame, now: Column, *, hubs: list[str] = LIVE_HUBS,
    routes: DataFrame | None = None,
) -> DataFrame:
    """The 19 flight features of upcoming departures between known airports.

    The inbound delay is known from the tail's state, or the flight's own reported
    delay without one, and is shown only within two hours of departure.
    """
    known = between_airports(departures, airports)
    state = tails.select("Tail_Number", "cumul", "legs", "immed")
    rows = known.join(state, "Tail_Number", "left")
    if routes is not None:
        rows = rows.join(routes.select("ORIGIN", "DEST", "hist_avg", "hist_std"), ["ORIGIN", "DEST"], "left")
    zero = F.lit(0.0)
    cumul, legs = F.coalesce("cumul", zero), F.coalesce("legs", F.lit(0)).cast("double")
    immed = F.coalesce("immed", "dep_delay_min", zero)
    h2dep = F.least(F.greatest(hours_between(now, "dep_scheduled"), zero) / 24, F.lit(1.0))
    hist = lambda c: F.coalesce(F.col(c), zero) if routes is not None else zero
    ds, dc = cyclic(F.hour("dep_scheduled"), 24)
    as_, ac = cyclic(F.coalesce(F.hour("arr_scheduled"), F.lit(0)), 24)
    ws, wc = cyclic(F.weekday("dep_scheduled"), 7)
    return rows.select(
        "flight_number", "ORIGIN", "DEST", "Tail_Number", "Operating_Airline", "dep_scheduled",
        cumul.alias("cumul_delay"), immed.alias("immed_inbound"),
        zero.alias("f_dep_delay_now"), ds.alias("f_dep_hour_sin"), dc.alias("f_dep_hour_cos"), zero.alias("f_turnaround"),
        F.when(h2dep < 2.0 / 24, clip(immed / 300.0, 0.0, 1.0)).otherwise(zero).alias("f_inbound"),
        F.lit(0.3).alias("f_distance"), ((cumul == 0) & (immed == 0)).cast("double").alias("f_is_first"),
        zero.alias("f_taxi_out_now"), ws.alias("f_dow_sin"), wc.alias("f_dow_cos"),
        F.col("ORIGIN").isin(hubs).cast("double").alias("f_hub_origin"), zero.alias("f_carrier_delay_now"),
        as_.alias("f_arr_hour_sin"), ac.alias("f_arr_hour_cos"), h2dep.alias("f_h2dep"),
        clip(cumul / 300.0, 0.0, 1.0).alias("f_cumul"), F.least(legs / 6.0, F.lit(1.0)).alias("f_legs"),
        clip(hist("hist_avg") / 300.0, -1.0, 1.0).alias("f_hist_avg"), clip(hist("hist_std") / 300.0, 0.0, 1.0).alias("f_hist_std"))


def live_edges(flight_rows: DataFrame, tails: DataFrame, *, late: float = 15.0) -> DataFrame:
    """departs_from for every flight; arrives_at when the tail's total or last delay is large."""
    state = tails.select("Tail_Number", F.col("cumul").alias("__c"), F.col("immed").alias("__i"))
    rows = flight_rows.join(state, "Tail_Number", "left")
    inbound = (F.coalesce("__c", F.lit(0.0)) > late) | (F.coalesce("__i", F.lit(0.0)) > late)
    edges = F.array_compact(F.array(
        F.struct(F.lit("departs_from").alias("edge_type"), F.col("ORIGIN").alias("airport")),
        F.when(inbound, F.struct(F.lit("arrives_at").alias("edge_type"), F.col("DEST").alias("airport")))))
    return rows.select("flight_number", "dep_scheduled", F.explode(edges).alias("e")).select(
        "flight_number", "dep_scheduled", "e.edge_type", "e.airport")


def airport_results(airport_pred: DataFrame, coords: DataFrame) -> DataFrame:
    """(airport, pred_delay, lat, lon) from predictions."""
    return airport_pred.join(coords.select("airport", "lat", "lon"), "airport", "left").select(
        "airport", F.bround("pred_delay", 1).alias("pred_delay"), "lat", "lon")


def airport_headline(results: DataFrame, *, congested: float = 15.0) -> DataFrame:
    return results.agg(
        F.count_if(F.col("pred_delay") > congested).alias("congested"),
        F.max_by("airport", F.struct(F.col("pred_delay"), F.col("airport"))).alias("worst_airport"),
        F.max("pred_delay").alias("worst_delay"))


def flight_results(flight_pred: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """Predicted delay, its cause and a status per flight; `flight_pred` holds pred per flight."""
    keys = ["flight_number", "dep_scheduled"]
    flags = edges.groupBy(*keys).agg(
        F.max(F.col("edge_type") == "departs_from").alias("__dep"), F.max(F.col("edge_type") == "arrives_at").alias("__arr"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return flight_pred.join(flags, keys, "left").select(
        *keys, "ORIGIN", "DEST", "Tail_Number", F.col("Operating_Airline").alias("Airline"),
        F.bround("pred", 1).alias("pred_delay"), delay_cause(yes("__dep"), yes("__arr")).alias("delay_cause"),
        predicted_status("pred").alias("status"), now.alias("snapshot_utc"))

"""Flight-shaped views over the generic test tables.

Every row is derived by Spark from `events` (one event is one flight leg and one
weather observation) and `nation` (airports), so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.expr import add_hours, add_minutes, floor_minute
from skyledger.functions.sequence import along_key


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def airports(spark: SparkSession, folder: str) -> DataFrame:
    """25 airports in 13 metro areas: keys 2j and 2j+1 lie about 25 km apart."""
    k = F.col("n_nationkey")
    half = F.floor(k / 2)
    return table(spark, folder, "nation").select(
        k.alias("key"),
        F.col("n_name").alias("airport"),
        (F.lit(25.0) + (half * 7) % 24 + (k % 2) * F.lit(0.2)).cast("double").alias("lat"),
        (F.lit(-120.0) + (half * 11) % 50 + (k % 2) * F.lit(0.1)).cast("double").alias("lon"),
    )


def flights(spark: SparkSession, folder: str) -> DataFrame:
    """The flights table: origin by formula, destination mostly the tail's next origin."""
    i = F.col("event_id")
    events = table(spark, folder, "events").select(
        "event_id", "ts", "user_id", "value",
        floor_minute("ts").alias("dep_datetime"),
        ((i * 7 + F.col("user_id") * 3) % 25).alias("o_key"),
    )
    legs = along_key(
        events, ["user_id"], ["ts", "event_id"], F.to_date("dep_datetime"), following=["o_key"]
    )
    nxt = F.col("next_row.o_key")
    stray = nxt.isNull() | (i % 10 == 0) | (nxt == F.col("o_key"))
    legs = legs.withColumn("d_key", F.when(stray, (F.col("o_key") + 1 + i % 24) % 25).otherwise(nxt))
    ap = airports(spark, folder).select("key", "airport")
    legs = legs.join(ap.select(F.col("key").alias("o_key"), F.col("airport").alias("ORIGIN")), "o_key").join(
        ap.select(F.col("key").alias("d_key"), F.col("airport").alias("DEST")), "d_key"
    )
    dep_delay = F.when(i % 50 != 7, F.floor(F.col("value") * 2 - 60).cast("double"))
    dep = F.col("dep_datetime")
    return legs.select(
        i.alias("flight_id"),
        F.to_date(dep).alias("FlightDate"),
        F.concat(F.lit("C"), (F.col("user_id") % 9).cast("string")).alias("Operating_Airline"),
        F.concat(F.lit("N"), F.col("user_id").cast("string")).alias("Tail_Number"),
        "ORIGIN", "DEST",
        dep_delay.alias("DepDelay"),
        (dep_delay - 5 + i % 11).alias("ArrDelay"),
        (8 + (i * 13) % 30).cast("double").alias("TaxiOut"),
        (3 + (i * 5) % 12).cast("double").alias("TaxiIn"),
        (40 + i % 180).cast("double").alias("AirTime"),
        (200 + (i * 37) % 2400).cast("double").alias("Distance"),
        F.lit(None).cast("double").alias("CarrierDelay"),
        F.year(dep).alias("Year"), F.month(dep).alias("Month"), F.dayofmonth(dep).alias("DayofMonth"),
        (F.weekday(dep) + 1).alias("DayOfWeek"),
        "dep_datetime",
        add_minutes(dep, 60 + i % 180).alias("arr_datetime"),
    )


def flight_times(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of `flights` that need no route: id, departure, its delay and the arrival."""
    i = F.col("event_id")
    return table(spark, folder, "events").select(
        i.alias("flight_id"), floor_minute("ts").alias("dep_datetime"),
        F.when(i % 50 != 7, F.floor(F.col("value") * 2 - 60).cast("double")).alias("DepDelay"),
    )


def weather(spark: SparkSession, folder: str) -> DataFrame:
    """Observations: one per event, at another airport and up to two hours off."""
    i = F.col("event_id")
    rows = table(spark, folder, "events").select(
        "event_id", "value", ((i * 11 + F.col("user_id")) % 25).alias("key"),
        add_hours(floor_minute("ts"), (i % 5 - 2).cast("int")).alias("datetime"),
    ).join(airports(spark, folder), "key")
    wind = (i * 7) % 180 / F.lit(10.0)
    return rows.select(
        "airport", "datetime",
        (F.col("lat") + (i % 3 - 1) * F.lit(0.001)).alias("latitude"),
        (F.col("lon") + (i % 3 - 1) * F.lit(0.001)).alias("longitude"),
        (F.col("key") * 10 + i % 5).cast("double").alias("elevation_m"),
        wind.alias("wind_speed_ms"),
        (wind + i % 9).alias("wind_gust_ms"),
        F.when(i % 17 != 3, 16000 - ((i * 11) % 16) * 1000).cast("double").alias("visibility_m"),
        F.when(i % 3 != 0, ((i * 13) % 20) / F.lit(4.0)).alias("precip_depth_mm"),
        (F.lit(1000) + i % 30).cast("double").alias("sea_level_pressure_hpa"),
        (300 * (i % 40)).cast("double").alias("ceiling_m"),
        (i % 9).cast("double").alias("sky_cover_oktas"),
        (i % 35 - 5 + F.col("value") / 100).alias("temp_c"),
    )


def predictions(snapshot_keys: DataFrame) -> DataFrame:
    """A prediction log on labelled (flight, snapshot) keys.

    Needs flight_id, snapshot_time, snap_idx, horizon_h and y.
    """
    i, h, y = F.col("flight_id"), F.col("horizon_h"), F.col("y")
    pred = y * F.lit(0.6) + (i * 17 + h * 5) % 40 - 10
    prob = F.least(F.greatest(y, F.lit(0.0)), F.lit(300.0)) / F.lit(300.0) * F.lit(0.6) + (
        (i * 31 + h * 7) % 1000
    ).cast("double") / F.lit(2500.0)
    rows = snapshot_keys.where(h.isNotNull()).select(
        "flight_id", "snap_idx", "snapshot_time", "horizon_h", pred.alias("pred"), prob.alias("severe_prob"),
        y.alias("actual"),
        *[(((i * (13 + k * 6) + h * 11) % 1000).cast("double") / F.lit(1000.0)).alias(f"p_ge_{t}")
          for k, t in enumerate((0, 15, 60, 120, 240, 720))],
    )
    err = F.col("pred") - F.col("actual")
    return rows.withColumns({"abs_err": F.abs(err), "sq_err": err * err})


def movements(spark: SparkSession, folder: str) -> DataFrame:
    """Status messages as a live feed repeats them: every flight is reported twice."""
    i = F.col("event_id")
    rows = table(spark, folder, "events").select(
        F.concat(F.lit("F"), i.cast("string")).alias("flight_number"),
        F.concat(F.lit("N"), F.col("user_id").cast("string")).alias("Tail_Number"),
        floor_minute("ts").alias("dep_scheduled"), F.col("ts").alias("event_time"),
        F.when(F.col("event_type").isin("view", "click", "purchase"), "landed").otherwise("scheduled").alias(
            "flight_status"),
        F.floor(F.col("value") * 2 - 60).cast("double").alias("arr_delay_min"),
    )
    return rows.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("poll"))


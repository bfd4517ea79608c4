"""Hourly weather, airport positions and same-metro edges."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.expr import EARTH_RADIUS_KM, floor_hour, haversine_km, share
from skyledger.functions.sequence import exact_percentiles
from skyledger.sources.schemas import WEATHER_MEASURES

# Coordinates that replace those of a mismatched station.
COORDINATE_OVERRIDES = {
    "CLE": (41.411, -81.849), "CMH": (39.998, -82.892), "FLL": (26.073, -80.150),
    "SLC": (40.788, -111.978), "TPA": (27.975, -82.533),
}


def hourly(obs: DataFrame) -> DataFrame:
    """One row per (airport, hour). Rain of an hour without any reading is 0, not null."""
    return obs.groupBy("airport", floor_hour("datetime").alias("obs_hour")).agg(
        F.avg("wind_speed_ms").alias("wind_speed_ms"),
        F.max("wind_gust_ms").alias("wind_gust_ms"),
        F.min("visibility_m").alias("visibility_m"),
        F.coalesce(F.sum("precip_depth_mm"), F.lit(0.0)).alias("precip_depth_mm"),
        F.avg("sea_level_pressure_hpa").alias("sea_level_pressure_hpa"),
        F.min("ceiling_m").alias("ceiling_m"),
        F.max("sky_cover_oktas").alias("sky_cover_oktas"),
        F.avg("temp_c").alias("temp_c"),
    )


def join_to_flights(flights: DataFrame, wx_hourly: DataFrame) -> DataFrame:
    """Weather at the origin in the hour of departure; flights without weather stay."""
    wx = wx_hourly.select(
        F.col("airport").alias("ORIGIN"), F.col("obs_hour").alias("dep_hour"), *WEATHER_MEASURES
    )
    keyed = flights.withColumn("dep_hour", floor_hour("dep_datetime"))
    return keyed.join(wx, ["ORIGIN", "dep_hour"], "left").select(*keyed.columns, *WEATHER_MEASURES)


def join_coverage(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.count(F.lit(1)).alias("flights"),
        share(F.col("wind_speed_ms").isNotNull()).alias("coverage"),
    )


def severe_flags(
    obs: DataFrame, *, low_visibility_m: float = 4800.0, high_wind_ms: float = 10.0, heavy_precip_mm: float = 2.0
) -> DataFrame:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return obs.withColumns({
        "low_vis": yes(F.col("visibility_m") < low_visibility_m),
        "high_wind": yes(F.col("wind_speed_ms") >= high_wind_ms),
        "heavy_precip": yes(F.col("precip_depth_mm") >= heavy_precip_mm),
    }).withColumn("any_severe", F.col("low_vis") | F.col("high_wind") | F.col("heavy_precip"))


def locations(obs: DataFrame) -> DataFrame:
    """Airport position: median of its observations, all three from one scan."""
    measures = {"lat": "latitude", "lon": "longitude", "elevation_m": "elevation_m"}
    values = obs.select("airport", F.explode(F.array(*[
        F.struct(F.lit(n).alias("measure"), F.col(c).cast("double").alias("value")) for n, c in measures.items()])).alias("m")).select("airport", "m.*")
    medians = exact_percentiles(values, ["airport", "measure"], "value", {"middle": 0.5})
    return medians.groupBy("airport").agg(*[F.max(F.when(F.col("measure") == n, F.col("middle"))).alias(n) for n in measures])


def override_locations(locs: DataFrame, overrides: Mapping[str, tuple[float, float]] = COORDINATE_OVERRIDES) -> DataFrame:
    spark = locs.sparkSession
    fixed = spark.createDataFrame(
        [(k, float(a), float(b)) for k, (a, b) in overrides.items()], "airport string, __lat double, __lon double"
    )
    return locs.join(fixed, "airport", "left").withColumns({
        "lat": F.coalesce("__lat", "lat"), "lon": F.coalesce("__lon", "lon"),
    }).drop("__lat", "__lon")


def same_metro(locs: DataFrame, *, radius_km: float = 35.0) -> DataFrame:
    """Airport pairs within `radius_km`, each once with src < dst.

    Positions go to cubes of radius-sized edges in earth-centred coordinates; points
    within the radius lie in the same or a touching cube, so the pairs come from an
    equality join on cubes and only near ones are measured.
    """
    placed = locs.where("lat is not null and lon is not null").select("airport", "lat", "lon")
    lat, lon, r = F.radians("lat"), F.radians("lon"), F.lit(EARTH_RADIUS_KM)
    axes = {"x": r * F.cos(lat) * F.cos(lon), "y": r * F.cos(lat) * F.sin(lon), "z": r * F.sin(lat)}
    cells = placed.select(
        "airport", "lat", "lon", *[F.floor(v / radius_km).cast("int").alias(k) for k, v in axes.items()]
    )
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    a = cells.select(F.col("airport").alias("src_airport"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"),
                     "x", "y", "z")
    for axis in ("x", "y", "z"):
        a = a.select("*", F.explode(near).alias("step")).withColumn(axis, F.col(axis) + F.col("step")).drop("step")
    b = cells.select(F.col("airport").alias("dst_airport"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"),
                     "x", "y", "z")
    d = haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    pairs = a.join(b, ["x", "y", "z"]).where("src_airport < dst_airport").withColumn("d", d)
    return pairs.where(F.col("d") <= radius_km).select(
        F.lit("weather").alias("edge_type"), "src_airport", "dst_airport",
        F.bround("d", 1).alias("distance_km"), F.lit(1.0).alias("edge_weight"),
    )

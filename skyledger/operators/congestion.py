"""Congestion edges between airports and the airport statistics behind them.

Flights are reduced once to counts and sums per (route, hour); everything else is
computed from that small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.expr import clip, floor_hour
from skyledger.functions.sequence import exact_percentiles
from skyledger.plans.staging import stage


def taxi_baseline(flights: DataFrame) -> DataFrame:
    """Mean, spread and count of taxi-out per airport; spread is 5 when unknown and at least 1."""
    return flights.where("ORIGIN is not null").groupBy(F.col("ORIGIN").alias("airport")).agg(
        F.avg("TaxiOut").alias("taxi_mean"),
        F.greatest(F.coalesce(F.stddev_samp("TaxiOut"), F.lit(5.0)), F.lit(1.0)).alias("taxi_std"),
        F.count("TaxiOut").alias("taxi_n"),
    )


def hourly_taxi(flights: DataFrame) -> DataFrame:
    return flights.where("ORIGIN is not null and DEST is not null and dep_datetime is not null and TaxiOut is not null"
                         ).groupBy("ORIGIN", floor_hour("dep_datetime").alias("dep_hour")).agg(
        F.avg("TaxiOut").alias("avg_taxi"), F.count("TaxiOut").alias("n"))


def taxi_anomaly_edges(
    flights: DataFrame, baseline: DataFrame, *, z: float = 1.3, min_hours: int = 10
) -> DataFrame:
    """Routes whose origin is congested in at least `min_hours` hours, in both directions.

    A route congested both ways appears twice per direction, once forward, once as the
    reverse of the other; self loops are removed.
    """
    route_hour = stage(flights.where(
        "ORIGIN is not null and DEST is not null and dep_datetime is not null and TaxiOut is not null"
    ).groupBy("ORIGIN", "DEST", floor_hour("dep_datetime").alias("dep_hour")).agg(
        F.sum("TaxiOut").alias("taxi_sum"), F.count(F.lit(1)).alias("n")), "route-hours")
    hour = route_hour.groupBy("ORIGIN", "dep_hour").agg((F.sum("taxi_sum") / F.sum("n")).alias("avg_taxi"))
    scored = hour.join(baseline.withColumnRenamed("airport", "ORIGIN"), "ORIGIN").withColumn(
        "z", (F.col("avg_taxi") - F.col("taxi_mean")) / F.col("taxi_std"))
    congested = scored.where(F.col("z") > z).select("ORIGIN", "dep_hour", "z")
    # Flight-weighted mean of z; one row per (route, hour), so hours are counted directly.
    routes = route_hour.join(congested, ["ORIGIN", "dep_hour"]).groupBy("ORIGIN", "DEST").agg(
        F.count(F.lit(1)).alias("co_congest_hours"), (F.sum(F.col("z") * F.col("n")) / F.sum("n")).alias("avg_zscore"),
    ).where(F.col("co_congest_hours") >= min_hours)
    ends = F.array(
        F.struct(F.col("ORIGIN").alias("src_airport"), F.col("DEST").alias("dst_airport")),
        F.struct(F.col("DEST").alias("src_airport"), F.col("ORIGIN").alias("dst_airport")),
    )
    both = routes.where("ORIGIN <> DEST").select(F.explode(ends).alias("e"), "avg_zscore", "co_congest_hours")
    out = both.select("e.src_airport", "e.dst_airport", "avg_zscore", "co_congest_hours").join(
        baseline.withColumnRenamed("airport", "src_airport"), "src_airport", "left")
    return out.select(
        "src_airport", "dst_airport", F.lit("congestion").alias("edge_type"), F.lit("taxi_anomaly").alias("sub_type"),
        clip(F.col("avg_zscore") / (z * 3), 0.0, 1.0).alias("edge_weight"),
        "taxi_mean", "taxi_std", F.col("taxi_n").cast("double").alias("taxi_n"), "avg_zscore", "co_congest_hours",
    )


def route_counts(flights: DataFrame) -> DataFrame:
    return flights.where("ORIGIN is not null and DEST is not null").groupBy("ORIGIN", "DEST").agg(
        F.count(F.lit(1)).alias("flight_count"))


def volume_edges(routes: DataFrame, *, min_pair: int = 50) -> DataFrame:
    """Busy routes, weighted by their count over the busiest one's. Takes `route_counts`."""
    busy = routes.where(F.col("flight_count") >= min_pair)
    top = busy.agg(F.max("flight_count").alias("m")).scalar()
    return busy.select(
        F.col("ORIGIN").alias("src_airport"), F.col("DEST").alias("dst_airport"),
        F.lit("congestion").alias("edge_type"), F.lit("volume").alias("sub_type"),
        (F.col("flight_count") / top).alias("edge_weight"), "flight_count",
    )


def top_hubs(routes: DataFrame, n: int = 30) -> DataFrame:
    """The n origins with most departures; equal counts go by airport code."""
    return routes.groupBy(F.col("ORIGIN").alias("airport")).agg(F.sum("flight_count").alias("departures")).orderBy(
        F.desc("departures"), "airport").limit(n)


def hub_spoke_edges(routes: DataFrame, hubs: DataFrame) -> DataFrame:
    """Routes from a hub and routes to a hub; a hub-to-hub route appears once as each."""
    hub = hubs.select("airport")
    pairs = routes.where("ORIGIN <> DEST")
    outbound = pairs.join(hub.withColumnRenamed("airport", "ORIGIN"), "ORIGIN", "left_semi").withColumn(
        "direction", F.lit("hub_to_spoke"))
    inbound = pairs.join(hub.withColumnRenamed("airport", "DEST"), "DEST", "left_semi").withColumn(
        "direction", F.lit("spoke_to_hub"))
    both = outbound.unionByName(inbound)
    top = both.agg(F.max("flight_count").alias("m")).scalar()
    return both.select(
        F.col("ORIGIN").alias("src_airport"), F.col("DEST").alias("dst_airport"),
        F.lit("congestion").alias("edge_type"), F.lit("hub_spoke").alias("sub_type"), "direction",
        clip(F.col("flight_count") / top, 0.0, 1.0).alias("edge_weight"), "flight_count",
    )


def congestion_edges(
    flights: DataFrame, *, min_pair: int = 50, hubs: int = 30, z: float = 1.3, min_hours: int = 10,
    reference_compat: bool = False,
) -> DataFrame:
    """The three kinds of congestion edge in one table.

    Kinds without a taxi baseline leave it null, so that a default applies later;
    `reference_compat` writes 0 there instead.
    """
    baseline, routes = stage(taxi_baseline(flights), "taxi"), stage(route_counts(flights), "routes")
    parts = [
        taxi_anomaly_edges(flights, baseline, z=z, min_hours=min_hours), volume_edges(routes, min_pair=min_pair),
        hub_spoke_edges(routes, top_hubs(routes, hubs)),
    ]
    names = ["src_airport", "dst_airport", "edge_type", "sub_type", "edge_weight"]
    taxi = ["taxi_mean", "taxi_std", "taxi_n"]
    every = parts[0].select(*names, *taxi)
    for part in parts[1:]:
        every = every.unionByName(part.select(*names), allowMissingColumns=True)
    return every.na.fill(0.0, taxi) if reference_compat else every


def airport_stats(flights: DataFrame, *, hubs: int = 30) -> DataFrame:
    """Departures, delays, exact 90th percentile, taxi and hub flag; either side may be missing."""
    dep = flights.where("ORIGIN is not null").groupBy(F.col("ORIGIN").alias("airport")).agg(
        F.count("flight_id").alias("total_departures"), F.avg("DepDelay").alias("avg_dep_delay"),
        F.avg("TaxiOut").alias("avg_taxi_out"), F.count(F.lit(1)).alias("departures"))
    p90 = exact_percentiles(
        flights.where("ORIGIN is not null").withColumnRenamed("ORIGIN", "airport"), ["airport"], "DepDelay",
        {"p90_dep_delay": 0.9})
    arr = flights.where("DEST is not null").groupBy(F.col("DEST").alias("airport")).agg(
        F.avg("ArrDelay").alias("avg_arr_delay"))
    every = dep.join(p90, "airport", "left").join(arr, "airport", "full_outer")
    # A ranking of airports, not of flights: one row per airport.
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("departures"), "airport"))
    return every.withColumn(
        "is_hub", ((rank <= hubs) & F.col("departures").isNotNull()).cast("int")
    ).select("airport", "total_departures", "avg_dep_delay", "p90_dep_delay", "avg_taxi_out", "avg_arr_delay", "is_hub")


def dynamic_weights(
    edges: DataFrame, airport_hour: DataFrame, day: str, *, z: float = 1.3, dep_delay: float = 15.0
) -> DataFrame:
    """Weight of each congestion edge in each hour of a day: the base scaled by the source airport's state.

    weight = base * (0.3 + 0.7 * max(taxi signal, delay signal)), both in [0, 1]. An hour without a row in
    `airport_hour` (airport, snapshot_time, avg_taxi_out, avg_dep_delay) counts as zero taxi and zero delay. All days
    together are edges times hours, so one day is made at a time.
    """
    start = F.lit(day).cast("timestamp_ntz")
    grid = F.explode(F.sequence(start, start + F.expr("INTERVAL 23 HOURS"), F.expr("INTERVAL 1 HOUR")))
    hour = airport_hour.where(F.to_date("snapshot_time") == F.lit(day).cast("date")).select(
        F.col("airport").alias("src_airport"), "snapshot_time", "avg_taxi_out", "avg_dep_delay")
    rows = edges.withColumn("snapshot_time", grid).join(hour, ["src_airport", "snapshot_time"], "left")
    mean = F.coalesce("taxi_mean", F.lit(19.0))
    std = F.greatest(F.coalesce("taxi_std", F.lit(5.0)), F.lit(1.0))
    taxi_signal = clip((F.coalesce("avg_taxi_out", F.lit(0.0)) - mean) / std / (z * 2), 0.0, 1.0)
    delay_signal = clip(F.coalesce("avg_dep_delay", F.lit(0.0)) / (dep_delay * 3), 0.0, 1.0)
    base = F.coalesce("edge_weight", F.lit(0.0))
    return rows.select(
        "snapshot_time", "src_airport", "dst_airport", "sub_type",
        (base * (F.lit(0.3) + F.lit(0.7) * F.greatest(taxi_signal, delay_signal))).alias("dynamic_weight"),
        base.alias("base_weight"),
    )

"""Historical priors and per-hour airport state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.expr import add_hours, floor_hour


def airport_priors(flights: DataFrame, *, hubs: int = 30, taxi_default: float = 19.0) -> DataFrame:
    """Static airport features: hub flag, mean delays and taxi, departures over the maximum.

    Missing means are 0; `taxi_baseline` keeps the taxi mean with its own default.
    """
    dep = flights.where("ORIGIN is not null").groupBy(F.col("ORIGIN").alias("airport")).agg(
        F.avg("DepDelay").alias("dep"), F.avg("TaxiOut").alias("taxi"), F.count("DepDelay").alias("n"))
    arr = flights.where("DEST is not null").groupBy(F.col("DEST").alias("airport")).agg(F.avg("ArrDelay").alias("arr"))
    every = dep.join(arr, "airport", "full_outer")
    by_count = Window.orderBy(F.desc_nulls_last("n"), "airport")  # one row per airport
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = every.withColumns({
        "rank": F.row_number().over(by_count), "top": F.max("n").over(whole),
    })
    zero = F.lit(0.0)
    return ranked.select(
        "airport",
        ((F.col("rank") <= hubs) & F.col("n").isNotNull()).cast("double").alias("is_hub"),
        F.coalesce("dep", zero).alias("hist_avg_dep_delay"), F.coalesce("taxi", zero).alias("hist_avg_taxi_out"),
        F.coalesce("arr", zero).alias("hist_avg_arr_delay"),
        F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("top").cast("double")), zero).alias(
            "total_departures_norm"),
        F.coalesce("taxi", F.lit(taxi_default)).alias("taxi_baseline"),
    )


# What an airport is given when there is no history at all.
DEFAULT_HUBS = [
    "ATL", "BOS", "CLT", "DEN", "DFW", "DTW", "EWR", "IAD", "IAH", "JFK",
    "LAX", "LGA", "MIA", "MSP", "ORD", "PHL", "PHX", "SEA", "SFO", "SLC",
]


def live_airport_stats(airports: DataFrame, flights: DataFrame | None, *, hubs: int = 30) -> DataFrame:
    """Static features for live use; without history every airport gets fixed defaults."""
    names = ["is_hub", "hist_avg_dep_delay", "hist_avg_taxi_out", "hist_avg_arr_delay", "total_departures_norm"]
    if flights is None:
        return airports.select(
            "airport", F.col("airport").isin(DEFAULT_HUBS).cast("double").alias("is_hub"),
            F.lit(8.0).alias("hist_avg_dep_delay"), F.lit(19.0).alias("hist_avg_taxi_out"),
            F.lit(5.0).alias("hist_avg_arr_delay"), F.lit(0.5).alias("total_departures_norm"))
    return airport_priors(flights, hubs=hubs).select("airport", *names)


def weather_climatology(flights: DataFrame) -> DataFrame:
    """Mean weather seen by departures per (airport, hour of day, month)."""
    zero = F.lit(0.0)
    return flights.where("ORIGIN is not null and dep_datetime is not null").groupBy(
        F.col("ORIGIN").alias("airport"), F.hour("dep_datetime").alias("hour_of_day"), F.month("dep_datetime").alias("month"),
    ).agg(
        F.coalesce(F.avg("wind_speed_ms"), zero).alias("wind"),
        F.coalesce(F.avg("precip_depth_mm"), zero).alias("precip"),
        F.coalesce(F.avg("visibility_m"), zero).alias("vis"),
    )


def forecast_proxy(climatology: DataFrame, *, keep_month: bool = False) -> DataFrame:
    """Climatology 3 and 6 hours ahead of each (airport, hour, month).

    Passing midnight moves to the next month unless `keep_month`. Each climatology row
    is sent to the two hours it serves as a forecast for, so there is no self-join.
    """
    def serves(ahead: int):
        wraps = F.col("hour_of_day") < ahead
        month = F.col("month") if keep_month else F.when(
            wraps, (F.col("month") + 10) % 12 + 1).otherwise(F.col("month"))
        return F.struct(
            F.lit(ahead).alias("ahead"), ((F.col("hour_of_day") - ahead + 24) % 24).alias("h"), month.alias("m"))

    sent = climatology.select("airport", "wind", "precip", "vis", F.explode(F.array(serves(3), serves(6))).alias("s"))
    picked = [
        F.coalesce(F.max(F.when(F.col("s.ahead") == a, F.col(c))), F.lit(0.0)).alias(f"{c}_{a}h")
        for a in (3, 6) for c in ("wind", "precip", "vis")
    ]
    return sent.groupBy("airport", F.col("s.h").alias("hour_of_day"), F.col("s.m").alias("month")).agg(*picked)


def traffic(flights: DataFrame) -> DataFrame:
    """Departures and arrivals 1 h, 3 h and 6 h ahead, per (airport, hour).

    Counts per hour are sent to the six hours before them and summed there. Only hours
    in which some airport has a departure are kept; an absent row means no traffic.
    """
    hours = flights.where("dep_datetime is not null").select(floor_hour("dep_datetime").alias("snapshot_time")).distinct()
    dep = flights.where("ORIGIN is not null and dep_datetime is not null").groupBy(
        F.col("ORIGIN").alias("airport"), floor_hour("dep_datetime").alias("hour")).agg(F.count(F.lit(1)).alias("dep"))
    arr = flights.where("DEST is not null and arr_datetime is not null").groupBy(
        F.col("DEST").alias("airport"), floor_hour("arr_datetime").alias("hour")).agg(F.count(F.lit(1)).alias("arr"))
    counts = dep.unionByName(arr, allowMissingColumns=True)
    sent = counts.select("airport", "dep", "arr", "hour", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("ahead")).select(
        "airport", "dep", "arr", "ahead", add_hours("hour", -F.col("ahead")).alias("snapshot_time"))
    loads = [
        F.coalesce(F.sum(F.when(F.col("ahead") <= w, F.col(c))), F.lit(0)).alias(f"{c}_{w}h")
        for c in ("dep", "arr") for w in (1, 3, 6)
    ]
    return sent.groupBy("airport", "snapshot_time").agg(*loads).join(hours, "snapshot_time", "left_semi").select(
        "airport", "snapshot_time", "dep_1h", "dep_3h", "dep_6h", "arr_1h", "arr_3h", "arr_6h")


def movements_per_hour(flights: DataFrame) -> DataFrame:
    """Departures and arrivals per (airport, hour)."""
    ends = F.array(
        F.struct(F.col("ORIGIN").alias("airport"), floor_hour("dep_datetime").alias("hour"),
                 F.lit(1).alias("d"), F.lit(0).alias("a")),
        F.struct(F.col("DEST").alias("airport"), floor_hour("arr_datetime").alias("hour"),
                 F.lit(0).alias("d"), F.lit(1).alias("a")),
    )
    return flights.select(F.explode(ends).alias("e")).select("e.*").where("airport is not null and hour is not null").groupBy(
        "airport", "hour").agg(F.sum("d").alias("departures"), F.sum("a").alias("arrivals"))


def airport_hour_state(flights: DataFrame) -> DataFrame:
    """Departure, weather and arrival means per (airport, hour): one pass over the flights.

    A flight adds to its origin in the departure hour and to its destination in the
    arrival hour; both land in one aggregation.
    """
    wx = [c for c in ("wind_speed_ms", "visibility_m", "precip_depth_mm") if c in flights.columns]
    none = lambda: F.lit(None).cast("double")
    def end(airport, ts, dep: bool):
        return F.struct(
            F.col(airport).alias("airport"), floor_hour(ts).alias("hour"), F.lit(dep).alias("is_dep"),
            (F.col("DepDelay") if dep else none()).alias("dep_delay"),
            (F.col("TaxiOut") if dep else none()).alias("taxi_out"),
            *[(F.col(c) if dep else none()).alias(c) for c in wx],
            (none() if dep else F.col("ArrDelay")).alias("arr_delay"),
            (none() if dep else F.col("TaxiIn")).alias("taxi_in"),
        )
    ends = flights.select(F.explode(F.array(
        end("ORIGIN", "dep_datetime", True), end("DEST", "arr_datetime", False))).alias("e")).select("e.*")
    return ends.where("airport is not null and hour is not null").groupBy(
        "airport", F.col("hour").alias("snapshot_time")
    ).agg(
        F.count_if("is_dep").alias("departures"),
        F.avg("dep_delay").alias("avg_dep_delay"), F.avg("taxi_out").alias("avg_taxi_out"),
        F.count("dep_delay").alias("dep_count"), *[F.avg(c).alias(c) for c in wx],
        F.avg("arr_delay").alias("avg_arr_delay"), F.avg("taxi_in").alias("avg_taxi_in"),
        F.count("arr_delay").alias("arr_count"),
    )


def airport_labels(flights: DataFrame) -> DataFrame:
    """What there is to forecast one hour ahead: mean departure delay per (airport, hour)."""
    return flights.where("ORIGIN is not null and dep_datetime is not null").groupBy(
        F.col("ORIGIN").alias("airport"), floor_hour("dep_datetime").alias("hour")
    ).agg(F.avg("DepDelay").alias("avg_dep_delay"))


def route_stats(flights: DataFrame, *, min_fine: int = 10, min_hour: int = 5) -> DataFrame:
    """Mean and spread of departure delay per route at three grains.

    grain 3 = (route, hour, weekday) with at least `min_fine` known delays, grain 2 =
    (route, hour) with at least `min_hour`, grain 1 = route. Sums are built once at the finest grain
    and rolled up. A missing spread is 15 (20 at route grain).
    """
    fine = flights.where(
        "ORIGIN is not null and DEST is not null and dep_datetime is not null"
    ).groupBy("ORIGIN", "DEST", F.hour("dep_datetime").alias("dep_hour"), F.weekday("dep_datetime").alias("dow")).agg(
        F.count("DepDelay").alias("n"), F.coalesce(F.sum("DepDelay"), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(F.col("DepDelay") * F.col("DepDelay")), F.lit(0.0)).alias("ss"),
    )
    grains = F.array(
        F.struct(F.lit(3).alias("grain"), F.col("dep_hour").alias("h"), F.col("dow").alias("d")),
        F.struct(F.lit(2).alias("grain"), F.col("dep_hour").alias("h"), F.lit(None).cast("int").alias("d")),
        F.struct(F.lit(1).alias("grain"), F.lit(None).cast("int").alias("h"), F.lit(None).cast("int").alias("d")),
    )
    rolled = fine.select("ORIGIN", "DEST", "n", "s", "ss", F.explode(grains).alias("g")).groupBy(
        "ORIGIN", "DEST", F.col("g.grain").alias("grain"), F.col("g.h").alias("dep_hour"), F.col("g.d").alias("dow")
    ).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    need = F.when(F.col("grain") == 3, min_fine).when(F.col("grain") == 2, min_hour).otherwise(1)
    return rolled.where(F.col("n") >= need).select(
        "ORIGIN", "DEST", "grain", "dep_hour", "dow", "n", (F.col("s") / F.col("n")).alias("hist_avg"),
        F.coalesce(_std("n", "s", "ss"), F.when(F.col("grain") == 1, 20.0).otherwise(15.0)).alias("hist_std"),
    )


GRAINS = {3: 0, 2: 1, 1: 3, 0: 15}  # grain -> which of (ORIGIN, DEST, dep_hour, dow) are rolled up, as grouping_id counts them


def route_table(flights: DataFrame, *, min_fine: int = 10, min_hour: int = 5) -> DataFrame:
    """`route_stats` and the overall row (grain 0) from one pass: sums at the finest grain, then grouping sets over them.

    The overall row counts every known delay, also of flights without a route or time, and has the plain sample deviation.
    """
    keys = ["ORIGIN", "DEST", "dep_hour", "dow"]
    delay = F.col("DepDelay")
    fine = flights.groupBy("ORIGIN", "DEST", F.hour("dep_datetime").alias("dep_hour"), F.weekday("dep_datetime").alias("dow")).agg(
        F.count(delay).alias("n"), F.coalesce(F.sum(delay), F.lit(0.0)).alias("s"), F.coalesce(F.sum(delay * delay), F.lit(0.0)).alias("ss"))
    whole = F.col("ORIGIN").isNotNull() & F.col("DEST").isNotNull() & F.col("dep_hour").isNotNull()  # others count in the overall row only
    fine = fine.select(*keys, "n", "s", "ss", *[F.when(whole, F.col(c)).alias(f"r_{c}") for c in ("n", "s", "ss")])
    sets = [keys, keys[:3], keys[:2], []]
    rolled = fine.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(
        F.grouping_id(*keys).alias("g"), *[F.sum(c).alias(c) for c in ("n", "s", "ss", "r_n", "r_s", "r_ss")])
    grain = F.create_map(*[F.lit(x) for k, g in GRAINS.items() for x in (g, k)])[F.col("g").cast("int")]
    timed = rolled.withColumn("grain", grain).select(
        *keys, "grain", *[F.when(F.col("grain") == 0, F.col(c)).otherwise(F.col(f"r_{c}")).alias(c) for c in ("n", "s", "ss")])
    need = F.when(F.col("grain") == 3, min_fine).when(F.col("grain") == 2, min_hour).otherwise(1)
    return timed.where(F.col("n") >= need).select(
        *keys[:2], "grain", *keys[2:], "n", (F.col("s") / F.col("n")).alias("hist_avg"),
        F.coalesce(_std("n", "s", "ss"), F.when(F.col("grain") == 1, 20.0).when(F.col("grain") > 1, 15.0)).alias("hist_std"))


def with_prior(flights: DataFrame, table: DataFrame, *, shifted_weekday: bool = False) -> DataFrame:
    """hist_avg, hist_std and the grain they come from: the finest row of `route_table` that knows the flight."""
    overall = table.where("grain = 0").select(F.struct("hist_avg", "hist_std").alias("o")).scalar()
    value = F.struct(F.col("hist_avg").alias("a"), F.col("hist_std").alias("s"), F.col("grain").alias("g"))
    key = F.concat_ws(":", F.col("dep_hour").cast("string"), F.col("dow").cast("string"))
    per_route = table.where("grain > 0").groupBy("ORIGIN", "DEST").agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("__known"))
    day = F.weekday("dep_datetime") - (1 if shifted_weekday else 0)
    hour = F.hour("dep_datetime").cast("string")
    found = F.coalesce(*[F.try_element_at("__known", k) for k in (F.concat(hour, F.lit(":"), day.cast("string")), hour, F.lit(""))],
                       F.struct(overall["hist_avg"].alias("a"), overall["hist_std"].alias("s"), F.lit(0).alias("g")))
    return flights.join(per_route, ["ORIGIN", "DEST"], "left").withColumn("__f", found).select(
        *flights.columns, F.col("__f.a").alias("hist_avg"), F.col("__f.s").alias("hist_std"), F.col("__f.g").alias("prior_grain"))


def _std(n: str, s: str, ss: str):
    """Sample deviation from count, sum and sum of squares (whole minutes, so exact sums)."""
    n, s, ss = F.col(n).cast("double"), F.col(s), F.col(ss)
    return F.when(n > 1, F.sqrt(F.greatest((ss - s * s / n) / (n - 1), F.lit(0.0))))


def global_stats(flights: DataFrame) -> DataFrame:
    return flights.agg(F.avg("DepDelay").alias("global_mean"), F.stddev_samp("DepDelay").alias("global_std"))


def with_route_prior(
    flights: DataFrame, routes: DataFrame, overall: DataFrame, *, shifted_weekday: bool = False
) -> DataFrame:
    """hist_avg and hist_std of the finest grain that knows the flight's route, hour and weekday.

    All grains of a route travel in one row (at most 24 + 168 entries), so a flight
    needs one join on its route instead of three. `shifted_weekday` looks weekdays up
    one day late, for comparison with tables built under that numbering.
    """
    value = F.struct(F.col("hist_avg").alias("a"), F.col("hist_std").alias("s"))
    key = F.concat_ws(":", F.col("dep_hour").cast("string"), F.col("dow").cast("string"))
    per_route = routes.groupBy("ORIGIN", "DEST").agg(
        F.max(F.when(F.col("grain") == 1, value)).alias("__route"),
        F.map_from_entries(F.collect_list(F.when(F.col("grain") > 1, F.struct(key, value)))).alias("__fine"),
    )
    hour = F.hour("dep_datetime").cast("string")
    day = F.weekday("dep_datetime")
    if shifted_weekday:
        day = day - 1
    found = F.coalesce(
        F.try_element_at("__fine", F.concat_ws(":", hour, day.cast("string"))),
        F.try_element_at("__fine", hour), F.col("__route"),
    )
    joined = flights.join(per_route, ["ORIGIN", "DEST"], "left").withColumn("__found", found)
    return joined.select(
        *flights.columns,
        F.coalesce("__found.a", overall.select("global_mean").scalar()).alias("hist_avg"),
        F.coalesce("__found.s", overall.select("global_std").scalar()).alias("hist_std"),
    )

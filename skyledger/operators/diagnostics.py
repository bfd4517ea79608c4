"""Studies of what drives delay: volume, taxi anomalies, hubs and time of day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.expr import pearson, share
from skyledger.functions.sequence import exact_percentiles, with_row
from skyledger.plans.staging import stage


def _late(c: str = "ArrDelay"):
    """Late flag that counts an unknown delay as not late."""
    return F.coalesce(F.col(c) > 15, F.lit(False))


def route_volume(flights: DataFrame, *, min_pair: int = 50) -> DataFrame:
    return flights.where("ORIGIN is not null and DEST is not null").groupBy("ORIGIN", "DEST").agg(
        F.count("ArrDelay").alias("flight_count"), F.avg("ArrDelay").alias("avg_arr_delay"), share(_late()).alias("pct_delayed")
    ).where(F.col("flight_count") >= min_pair)


def volume_quartiles(flights: DataFrame, *, min_pair: int = 50) -> DataFrame:
    """Routes in quartiles of volume (right-closed, lowest included) and their mean delay."""
    routes = stage(route_volume(flights, min_pair=min_pair), "route-volume")
    cuts = exact_percentiles(routes, [], "flight_count", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    q1, q2, q3, n = F.col("q1"), F.col("q2"), F.col("q3"), F.col("flight_count")
    quartile = F.when(n <= q1, "Q1 (low)").when(n <= q2, "Q2").when(n <= q3, "Q3").otherwise("Q4 (high)")
    return with_row(routes, cuts).groupBy(quartile.alias("volume_quartile")).agg(
        F.count(F.lit(1)).alias("n_routes"), F.avg("flight_count").alias("avg_flights"),
        F.avg("avg_arr_delay").alias("avg_arr_delay"), F.avg("pct_delayed").alias("pct_delayed"))


def volume_correlation(flights: DataFrame, *, min_pair: int = 50) -> DataFrame:
    return route_volume(flights, min_pair=min_pair).agg(
        pearson("flight_count", "avg_arr_delay").alias("r"), F.count(F.lit(1)).alias("routes"))


def _taxi_cells(flights: DataFrame) -> DataFrame:
    """Flights reduced to one row per (origin, taxi minutes) with sums, scored against the origin.

    Taxi times are whole minutes, so this table is small and the baseline joins to it
    rather than to the flights.
    """
    cells = stage(flights.where("ORIGIN is not null and TaxiOut is not null").groupBy("ORIGIN", "TaxiOut").agg(
        F.count(F.lit(1)).alias("n"), F.count("ArrDelay").alias("n_arr"),
        F.coalesce(F.sum("ArrDelay"), F.lit(0.0)).alias("s_arr"),
        F.coalesce(F.sum(F.col("ArrDelay") * F.col("ArrDelay")), F.lit(0.0)).alias("ss_arr"),
        F.sum(_late().cast("long")).alias("n_late")), "taxi-cells")
    t, n = F.col("TaxiOut"), F.col("n")
    sums = cells.groupBy("ORIGIN").agg(F.sum("n").alias("m"), F.sum(n * t).alias("st"), F.sum(n * t * t).alias("stt"))
    m = F.col("m")
    var = F.when(m > 1, F.greatest((F.col("stt") - F.col("st") * F.col("st") / m) / (m - 1), F.lit(0.0)))
    base = sums.select("ORIGIN", (F.col("st") / m).alias("mean"), F.sqrt(var).alias("std"))
    std = F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))
    return cells.join(base, "ORIGIN").withColumn("z", (t - F.col("mean")) / std)


def taxi_bins(flights: DataFrame, *, z: float = 1.5) -> DataFrame:
    """Arrival delay by taxi-out anomaly at the origin; bins are right-closed."""
    s = F.col("z")
    label = (
        F.when(s <= -1, "Very low").when(s <= 0, "Below avg").when(s <= 1, "Normal").when(s <= z, "Elevated")
        .when(s > z, "Congested"))
    return _taxi_cells(flights).withColumn("taxi_bin", label).where("taxi_bin is not null").groupBy("taxi_bin").agg(
        F.sum("n_arr").alias("n_flights"), F.try_divide(F.sum("s_arr"), F.sum("n_arr").cast("double")).alias("avg_arr_delay"),
        (F.sum("n_late") / F.sum("n")).alias("pct_delayed"), (F.sum(F.col("n") * F.col("TaxiOut")) / F.sum("n")).alias("avg_taxi_out"))


def taxi_uplift(flights: DataFrame, *, z: float = 1.5) -> DataFrame:
    """Correlation of taxi z-score with arrival delay, and mean delay at three taxi levels."""
    cells = _taxi_cells(flights).where("z is not null")
    n, s, x = F.col("n_arr"), F.col("s_arr"), F.col("z")
    mean = lambda c: F.try_divide(F.sum(F.when(c, s)), F.sum(F.when(c, n)).cast("double"))
    row = cells.agg(
        F.sum(n).alias("N"), F.sum(n * x).alias("sx"), F.sum(n * x * x).alias("sxx"), F.sum(s).alias("sy"),
        F.sum("ss_arr").alias("syy"), F.sum(s * x).alias("sxy"), mean(x <= 0).alias("normal"),
        mean((x > 0) & (x <= z)).alias("elevated"), mean(x > z).alias("congested"))
    N = F.col("N").cast("double")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / N
    spread = F.sqrt((F.col("sxx") - F.col("sx") * F.col("sx") / N) * (F.col("syy") - F.col("sy") * F.col("sy") / N))
    return row.select(F.try_divide(cov, spread).alias("r"), "normal", "elevated", "congested",
                      (F.col("congested") - F.col("normal")).alias("uplift"))


def hub_comparison(flights: DataFrame, hubs: DataFrame) -> DataFrame:
    """Delay and taxi metrics of hub and spoke departures, and hub minus spoke."""
    flagged = _flag_hubs(flights, hubs)
    base = flagged.groupBy("is_hub").agg(
        F.avg("ArrDelay").alias("avg_arr_delay"), (share(_late()) * 100).alias("pct_delayed"),
        F.avg("TaxiOut").alias("avg_taxi_out"), F.stddev_samp("ArrDelay").alias("std_arr_delay"))
    wide = base.join(exact_percentiles(flagged, ["is_hub"], "ArrDelay", {"p95_arr_delay": 0.95}), "is_hub", "left")
    names = ["avg_arr_delay", "pct_delayed", "avg_taxi_out", "std_arr_delay", "p95_arr_delay"]
    long = wide.select("is_hub", F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])).alias("x")).select("is_hub", "x.*")
    pick = lambda hub: F.max(F.when(F.col("is_hub") == hub, F.col("v")))
    return long.groupBy("metric").agg(pick(True).alias("hubs"), pick(False).alias("spokes")).withColumn(
        "difference", F.col("hubs") - F.col("spokes"))


def _flag_hubs(flights: DataFrame, hubs: DataFrame) -> DataFrame:
    hub = hubs.select(F.col("airport").alias("ORIGIN"), F.lit(True).alias("__hub"))
    return flights.where("ORIGIN is not null").select("ORIGIN", "ArrDelay", "TaxiOut").join(hub, "ORIGIN", "left").withColumn(
        "is_hub", F.coalesce("__hub", F.lit(False)))


def hub_ranking(flights: DataFrame, hubs: DataFrame, *, top: int = 10) -> DataFrame:
    per = flights.where("ORIGIN is not null").groupBy("ORIGIN").agg(
        F.count("ArrDelay").alias("departures"), F.avg("ArrDelay").alias("avg_arr_delay"),
        share(_late()).alias("pct_delayed"), F.avg("TaxiOut").alias("avg_taxi_out"))
    return per.join(hubs.select(F.col("airport").alias("ORIGIN")), "ORIGIN", "left_semi").orderBy(
        F.desc("avg_arr_delay"), "ORIGIN").limit(top)


def hour_profile(flights: DataFrame) -> DataFrame:
    return flights.where("dep_datetime is not null").groupBy(F.hour("dep_datetime").alias("hour")).agg(
        F.avg("DepDelay").alias("avg_dep_delay"), F.avg("ArrDelay").alias("avg_arr_delay"), F.avg("TaxiOut").alias("avg_taxi_out"),
        share(_late()).alias("pct_delayed"), F.count(F.lit(1)).alias("flights"))


def day_buildup(flights: DataFrame) -> DataFrame:
    """Mean of the hourly means in the morning (6-9) and the afternoon (15-19)."""
    h = F.col("hour")
    return hour_profile(flights).agg(
        F.avg(F.when(h.between(6, 9), F.col("avg_arr_delay"))).alias("morning"),
        F.avg(F.when(h.between(15, 19), F.col("avg_arr_delay"))).alias("afternoon")
    ).withColumn("buildup", F.col("afternoon") - F.col("morning"))

"""Hourly snapshot tables: airports, flights, labels and edges, keyed by snapshot_time.

A flight belongs to the snapshots of the `window_h` hours up to and including its
departure hour. On an hourly grid that is the interval test t <= dep < t + window,
so every flight produces its own snapshot rows and no interval join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.expr import (
    add_hours, ceil_hour, clip, cyclic, floor_hour, horizon_band, hour_number, hours_between, mask_by_horizon,
)
from skyledger.operators.clean import between_airports

MAX_DELAY, MAX_DISTANCE, MAX_TURNAROUND, MAX_CUMUL, MAX_LEGS = 300.0, 5000.0, 90.0, 300.0, 6.0
TRAFFIC_SCALE = {"1h": 25.0, "3h": 60.0, "6h": 120.0}


def bounds(flights: DataFrame) -> DataFrame:
    """One row: first and last snapshot hour."""
    return flights.agg(
        floor_hour(F.min("dep_datetime")).alias("first_hour"), ceil_hour(F.max("dep_datetime")).alias("last_hour"))


def _first(flights: DataFrame) -> Column:
    return bounds(flights).select("first_hour").scalar()


def _last(flights: DataFrame) -> Column:
    return bounds(flights).select("last_hour").scalar()


def hours(flights: DataFrame) -> DataFrame:
    """The hourly grid with its running number."""
    span = bounds(flights).select(F.posexplode(F.sequence("first_hour", "last_hour", F.expr("INTERVAL 1 HOUR"))))
    return span.select(F.col("col").alias("snapshot_time"), F.col("pos").alias("snap_idx"))


# ---------------------------------------------------------------- airports


def airport_hours(airports: DataFrame, flights: DataFrame) -> DataFrame:
    """Every airport in every hour of the grid.

    Days are spread over the cluster before hours are produced: a short airport list
    would otherwise sit in one partition and produce the whole grid in one task.
    """
    first, last = _first(flights), _last(flights)
    days = F.sequence(first.cast("date"), last.cast("date"))
    parts = int(airports.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = airports.select("airport").distinct().select("airport", F.explode(days).alias("day")).repartition(parts, "airport", "day")
    hour = F.explode(F.sequence(F.lit(0), F.lit(23)))
    return spread.select("airport", "day", hour.alias("h")).select(
        "airport", add_hours(F.col("day").cast("timestamp_ntz"), F.col("h")).alias("snapshot_time")
    ).where(F.col("snapshot_time").between(first, last))


def airport_table(
    flights: DataFrame, airports: DataFrame, priors: DataFrame, state: DataFrame, traffic: DataFrame,
    forecast: DataFrame,
) -> DataFrame:
    """The 30 airport features of every airport in every hour, and the label of the next hour.

    Hour-level inputs are already aggregated by (airport, hour), the key of the grid,
    so the joins reuse that partitioning.
    """
    grid = airport_hours(airports, flights)
    label = state.where(F.col("departures") > 0).select(
        "airport", add_hours("snapshot_time", -1).alias("snapshot_time"), F.col("avg_dep_delay").alias("y"))
    keys = ["airport", "snapshot_time"]
    rows = (
        grid.join(state.drop("departures"), keys, "left").join(traffic, keys, "left").join(label, keys, "left")
        .withColumns({"hour_of_day": F.hour("snapshot_time"), "month": F.month("snapshot_time")})
        .join(forecast, ["airport", "hour_of_day", "month"], "left").join(priors, "airport", "left")
    )
    known = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    static = ["is_hub", "hist_avg_dep_delay", "hist_avg_taxi_out", "hist_avg_arr_delay", "total_departures_norm"]
    dynamic = {
        "avg_dep_delay": "avg_dep_delay", "avg_arr_delay": "avg_arr_delay", "avg_taxi_out": "avg_taxi_out",
        "avg_taxi_in": "avg_taxi_in", "dep_count": "dep_count", "arr_count": "arr_count",
        "wind": "wind_speed_ms", "vis": "visibility_m", "precip": "precip_depth_mm",
    }
    load = [f"{c}_{w}" for c, w in (("dep", "1h"), ("arr", "1h"), ("dep", "3h"), ("dep", "6h"), ("arr", "3h"), ("arr", "6h"))]
    ahead = [f"{c}_{a}h" for a in (3, 6) for c in ("wind", "precip", "vis")]
    hour_sin, hour_cos = cyclic("hour_of_day", 24)
    month_sin, month_cos = cyclic("month", 12)
    return rows.select(
        "snapshot_time", "airport", *[known(c).alias(c) for c in static],
        *[known(c).alias(n) for n, c in dynamic.items()],
        *[F.least(known(c) / TRAFFIC_SCALE[c[-2:]], F.lit(1.0)).alias(f"load_{c}") for c in load],
        *[known(c).alias(f"forecast_{c}") for c in ahead],
        hour_sin.alias("hour_sin"), hour_cos.alias("hour_cos"), month_sin.alias("month_sin"), month_cos.alias("month_cos"),
        "y", F.col("y").isNotNull().alias("y_mask"),
    )


# ---------------------------------------------------------------- flights


def flight_keys(flights: DataFrame, *, window_h: int = 8) -> DataFrame:
    """(flight, snapshot) pairs with hours to departure, label y and exclusive band.

    horizon_h is null where the delay is unknown; flights in snapshots before the first
    hour of the grid are left out.
    """
    first = _first(flights)
    hour = floor_hour("dep_datetime")
    # Everything about the hour is worked out once per flight, before it is repeated.
    per_flight = flights.where("dep_datetime is not null").select(
        "flight_id", "DepDelay", hour.alias("h"), hour_number(first, hour).alias("n"),
        (F.minute("dep_datetime") * 60 + F.second("dep_datetime")).alias("rest"))
    rows = per_flight.select("*", F.explode(F.sequence(F.lit(0), F.lit(window_h - 1))).alias("k")).where("n >= k")
    h2dep = (F.col("k") * 3600 + F.col("rest")) / F.lit(3600.0)
    valid = F.col("DepDelay").isNotNull()
    return rows.select(
        "flight_id", add_hours("h", -F.col("k")).alias("snapshot_time"), (F.col("n") - F.col("k")).alias("snap_idx"),
        h2dep.alias("h2dep"), F.when(valid, F.col("DepDelay")).otherwise(F.lit(0.0)).alias("y"),
        F.when(valid, horizon_band(h2dep)).alias("horizon_h"),
    )


def enrich(flights: DataFrame, rotation: DataFrame, airports: DataFrame, priors: DataFrame) -> DataFrame:
    """Per-flight inputs of the snapshot rows, joined once before the flight is repeated per hour.

    `flights` carries the tail propagation and route prior columns. `rotation` adds the
    inbound leg (override in the departure hour) and the next leg (support rows).
    """
    known = between_airports(rotation, airports, "src_airport", "mid_airport")
    inbound = known.select(
        F.col("leg2_flight_id").alias("flight_id"), F.lit(True).alias("has_inbound"),
        F.coalesce("leg1_arr_delay", F.lit(0.0)).alias("rot_inbound"),
        F.coalesce("turnaround_min", F.lit(0.0)).alias("rot_turnaround"),
    )
    outbound = known.select(F.col("leg1_flight_id").alias("flight_id"), floor_hour("leg2_dep").alias("support_time"))
    hub = priors.select(F.col("airport").alias("ORIGIN"), F.col("is_hub").alias("hub_origin"))
    return flights.join(inbound, "flight_id", "left").join(outbound, "flight_id", "left").join(hub, "ORIGIN", "left")


def flight_table(
    enriched: DataFrame, flights: DataFrame, *, window_h: int = 8, landed_only: bool = False
) -> DataFrame:
    """The 19 flight features per (flight, snapshot), with label and band.

    Support rows are first legs that have landed before the snapshot in which their
    second leg departs and that are not in its window themselves; they carry features
    but no label. `flights` gives the ends of the hourly grid. `landed_only` hides tail
    propagation until the inbound leg is in.
    """
    first, last = _first(flights), _last(flights)
    zero = F.lit(0.0)
    base = enriched.where("dep_datetime is not null").withColumn("__h", floor_hour("dep_datetime"))
    s, hour = F.col("support_time"), F.expr("INTERVAL 1 HOUR")
    in_window = (F.col("__h") >= s) & (F.col("dep_datetime") < s + hour * window_h)
    supports = s.isNotNull() & (F.col("arr_datetime") < s) & ~in_window & s.between(first, last)
    dep_sin, dep_cos = cyclic(F.hour("dep_datetime"), 24)
    arr_sin, arr_cos = cyclic(F.coalesce(F.hour("arr_datetime"), F.lit(0)), 24)
    dow_sin, dow_cos = cyclic(F.weekday("dep_datetime"), 7)
    # What does not change from snapshot to snapshot is worked out once per flight.
    per_flight = base.withColumns({
        "__n": hour_number(first, "__h"), "__ns": F.when(supports, hour_number(first, s)),
        "__rest": F.minute("dep_datetime") * 60 + F.second("dep_datetime"),
        "__sh": F.when(supports, F.greatest(hours_between(s, "dep_datetime"), zero)),
        "f_dep_delay_now": zero, "f_dep_hour_sin": dep_sin, "f_dep_hour_cos": dep_cos, "f_taxi_out_now": zero,
        "f_distance": clip(F.coalesce("Distance", zero) / MAX_DISTANCE, 0.0, 1.0),
        "f_dow_sin": dow_sin, "f_dow_cos": dow_cos, "f_hub_origin": F.coalesce("hub_origin", zero), "f_carrier_delay_now": zero,
        "f_arr_hour_sin": arr_sin, "f_arr_hour_cos": arr_cos,
        "f_hist_avg": F.coalesce(clip(F.col("hist_avg") / MAX_DELAY, -1.0, 1.0), zero),
        "f_hist_std": F.coalesce(clip(F.col("hist_std") / MAX_DELAY, 0.0, 1.0), zero),
        "__inbound_now": clip(F.col("rot_inbound") / MAX_DELAY, 0.0, 1.0),
        "__turn_now": clip(F.col("rot_turnaround") / MAX_TURNAROUND, 0.0, 1.0),
    })
    # Hours before the departure hour; -1 stands for the support row.
    steps = F.concat(
        F.array(*[F.lit(k) for k in range(window_h)]),
        F.when(F.col("__ns").isNotNull(), F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")))
    rows = per_flight.withColumn("__k", F.explode(steps)).where("__k < 0 or __n >= __k")
    k, support = F.col("__k"), F.col("__k") < 0
    rows = rows.withColumn("snapshot_time", F.when(support, s).otherwise(add_hours("__h", -k)))

    cumul, legs, immed = F.col("cumul_delay"), F.col("legs_done").cast("double"), F.col("immed_inbound")
    if landed_only:
        seen = F.coalesce(F.col("inbound_arr") < F.col("snapshot_time"), F.lit(False))
        cumul, legs, immed = [F.when(seen, c).otherwise(zero) for c in (cumul, legs, immed)]
    override = (k == 0) & F.coalesce("has_inbound", F.lit(False))
    h2dep = F.when(support, F.col("__sh")).otherwise((k * 3600 + F.col("__rest")) / F.lit(3600.0))
    valid = ~support & F.col("DepDelay").isNotNull()
    return rows.select(
        "snapshot_time", F.when(support, F.col("__ns")).otherwise(F.col("__n") - k).alias("snap_idx"),
        "flight_id", support.alias("is_support"), "ORIGIN", "DEST", "Tail_Number", "dep_datetime", "arr_datetime",
        "f_dep_delay_now", "f_dep_hour_sin", "f_dep_hour_cos",
        F.when(override, F.col("__turn_now")).otherwise(zero).alias("f_turnaround"),
        F.when(override, F.col("__inbound_now")).otherwise(clip(immed / MAX_DELAY, 0.0, 1.0)).alias("f_inbound"),
        "f_distance", F.when(override, zero).otherwise(((cumul == 0) & (immed == 0)).cast("double")).alias("f_is_first"),
        "f_taxi_out_now", "f_dow_sin", "f_dow_cos", "f_hub_origin", "f_carrier_delay_now", "f_arr_hour_sin", "f_arr_hour_cos",
        F.least(h2dep / 24, F.lit(1.0)).alias("f_h2dep"), clip(cumul / MAX_CUMUL, 0.0, 1.0).alias("f_cumul"),
        F.least(legs / MAX_LEGS, F.lit(1.0)).alias("f_legs"), "f_hist_avg", "f_hist_std",
        F.when(valid, F.col("DepDelay")).otherwise(zero).alias("y"), F.when(valid, horizon_band(h2dep)).alias("horizon_h"),
        immed.alias("immed_inbound"),
    )


GATE = ["f_dep_delay_now", "f_turnaround", "f_inbound", "f_taxi_out_now", "f_carrier_delay_now"]
GATE_PARTIAL = ["f_dep_delay_now", "f_taxi_out_now"]


def mask_flights(table: DataFrame) -> DataFrame:
    """Hide gate features that would not be known at the row's distance to departure."""
    return table.withColumns({
        c: mask_by_horizon(c, "f_h2dep", partial=c in GATE_PARTIAL) for c in GATE
    })


# ---------------------------------------------------------------- edges


def departs_from(
    flight_rows: DataFrame, state: DataFrame, priors: DataFrame, *, dep_delay: float = 15.0, taxi_factor: float = 1.3
) -> DataFrame:
    """Every flight to its origin, weight 1 when the origin is congested in that hour."""
    hot = state.join(priors.select("airport", "taxi_baseline"), "airport", "left").where(
        (F.col("avg_dep_delay") > dep_delay)
        | (F.col("avg_taxi_out") > F.coalesce("taxi_baseline", F.lit(19.0)) * taxi_factor)
    ).select(F.col("airport").alias("ORIGIN"), "snapshot_time", F.lit(1.0).alias("__w"))
    return flight_rows.join(hot, ["ORIGIN", "snapshot_time"], "left").select(
        "snapshot_time", "flight_id", F.col("ORIGIN").alias("airport"),
        F.coalesce("__w", F.lit(0.0)).alias("edge_weight"))


def arrives_at(flight_rows: DataFrame, *, inbound: float = 15.0) -> DataFrame:
    """Flights whose inbound aircraft arrived late, to their destination."""
    return flight_rows.where(F.col("immed_inbound") > inbound).select(
        "snapshot_time", "flight_id", F.col("DEST").alias("airport"), F.lit(1.0).alias("edge_weight"))


def reverse(edges: DataFrame) -> DataFrame:
    """The same edges from airport to flight."""
    return edges.select("snapshot_time", F.col("airport").alias("src_airport"), F.col("flight_id").alias("dst_flight_id"), "edge_weight")


def flight_rotation(rotation: DataFrame, airports: DataFrame, flights: DataFrame) -> DataFrame:
    """Leg 1 to leg 2 in the departure hour of leg 2, once leg 1 has landed before that hour.

    Leg 2 is in that snapshot when both its ends are known airports, leg 1 when both of
    its are (as support row), so membership is a test on the edge itself.
    """
    known = between_airports(between_airports(rotation, airports, "src_airport", "mid_airport"), airports, "mid_airport", "dst_airport")
    t = floor_hour("leg2_dep")
    return known.where((F.col("leg1_arr") < t) & t.between(_first(flights), _last(flights))).select(
        t.alias("snapshot_time"), F.col("leg1_flight_id").alias("src_flight_id"), F.col("leg2_flight_id").alias("dst_flight_id"),
        (clip(F.coalesce("leg1_arr_delay", F.lit(0.0)), 0.0, MAX_DELAY) / MAX_DELAY).alias("delay_norm"),
        (clip("turnaround_min", 0.0, MAX_TURNAROUND) / MAX_TURNAROUND).alias("turnaround_norm"),
    )


# ---------------------------------------------------------------- graph features and reports


def neighbour_context(flight_rows: DataFrame, edges: DataFrame, airport_rows: DataFrame) -> DataFrame:
    """Airport context of each flight, and what flights send to airports, as plain aggregates.

    Per (airport, hour): weighted sum, mean and count over incoming flight edges; joined
    back to the flights departing there together with the airport's own features.
    """
    # As many rows on both sides; a compressed file of a few columns looks small enough to broadcast long before it is.
    sent = edges.hint("merge").join(
        flight_rows.select("snapshot_time", "flight_id", "f_inbound", "f_cumul", "f_hist_avg"), ["snapshot_time", "flight_id"])
    per_airport = sent.groupBy("snapshot_time", "airport").agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.sum(F.col("edge_weight") * F.col("f_inbound")).alias("sum_inbound"),
        F.sum(F.col("edge_weight") * F.col("f_cumul")).alias("sum_cumul"), F.avg("f_hist_avg").alias("mean_hist"))
    context = airport_rows.select(
        "snapshot_time", "airport", "avg_dep_delay", "avg_taxi_out", "load_dep_3h", "wind", "precip"
    ).join(per_airport, ["snapshot_time", "airport"], "left")
    named = context.select(
        "snapshot_time", F.col("airport").alias("ORIGIN"), F.col("avg_dep_delay").alias("ctx_dep_delay"),
        F.col("avg_taxi_out").alias("ctx_taxi_out"), F.col("load_dep_3h").alias("ctx_load"), F.col("wind").alias("ctx_wind"),
        F.col("precip").alias("ctx_precip"),
        *[F.coalesce(c, F.lit(0)).cast("double").alias(f"ctx_{c}") for c in ("n_edges", "sum_inbound", "sum_cumul", "mean_hist")])
    return flight_rows.join(named, ["snapshot_time", "ORIGIN"], "left")


def tail_score(keys: DataFrame) -> DataFrame:
    """Severity score of each snapshot over its labelled flights."""
    y = F.col("y")
    weight = F.when(y >= 720, 3.0).when(y >= 240, 2.0).when(y >= 120, 1.0).when(y >= 60, 0.5).otherwise(0.0)
    return keys.groupBy("snapshot_time", "snap_idx").agg(
        F.sum(F.when(F.col("horizon_h").isNotNull(), weight).otherwise(F.lit(0.0))).alias("tail_score"))


def census(keys: DataFrame, flights: DataFrame) -> DataFrame:
    """Flights per snapshot of the grid, zero included."""
    counts = keys.groupBy("snapshot_time").agg(
        F.count(F.lit(1)).alias("flights"), F.count("horizon_h").alias("labelled"))
    zero = F.lit(0)
    return hours(flights).join(counts, "snapshot_time", "left").select(
        "snapshot_time", "snap_idx", F.coalesce("flights", zero).alias("flights"), F.coalesce("labelled", zero).alias("labelled"))

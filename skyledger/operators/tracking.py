"""Following single flights towards departure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.expr import actual_status, add_hours, add_minutes, clip, clock, cyclic, floor_hour, share
from skyledger.functions.timejoin import nearest_row
from skyledger.operators.clean import on_date

LEADS = (6, 3, 1)


def nearest_snapshot(dep: Column | str, hours: int) -> Column:
    """The hourly snapshot closest to `hours` before departure; a tie goes to the earlier one.

    On an hourly grid the nearest snapshot is never more than 30 minutes away, which is
    within the 35 minutes accepted.
    """
    target = add_hours(dep, -hours)
    base = floor_hour(target)
    past = F.minute(target) * 60 + F.second(target)
    return F.when(past > 1800, base + F.expr("INTERVAL 1 HOUR")).otherwise(base)


def snapshots_at_leads(flights: DataFrame, snapshots: DataFrame, *, within_min: float = 35.0) -> DataFrame:
    """flight_id, lead_h and snapshot_time: for each flight and lead the snapshot nearest to that lead, at whatever times snapshots were taken.

    A tie goes to the earlier snapshot; a lead without one closer than `within_min` minutes has a null. A flight's departure must be known.
    """
    asked = flights.where("dep_datetime is not null").select("flight_id", "dep_datetime", F.explode(F.array(*[F.lit(h) for h in LEADS])).alias("lead_h"))
    asked = asked.withColumn("wanted", add_minutes("dep_datetime", -60 * F.col("lead_h")))
    found = nearest_row(asked, snapshots.select("snapshot_time"), [], "wanted", "snapshot_time", [], within_s=within_min * 60, strict=True, slot_s=3600)
    return found.select("flight_id", "lead_h", F.col("match.snapshot_time").alias("snapshot_time"))


def actuals_by_natural_key(lookup: DataFrame, source: DataFrame, *, dedupe: bool = False) -> DataFrame:
    """Attach arrival delays by (origin, destination, departure time).

    Duplicates on the right multiply rows; `dedupe` keeps the largest delay per key.
    """
    keys = ["ORIGIN", "DEST", "dep_datetime"]
    known = source.select(*keys, F.col("ArrDelay").alias("actual_arr_delay"))
    if dedupe:
        known = known.groupBy(*keys).agg(F.max("actual_arr_delay").alias("actual_arr_delay"))
    return lookup.join(known, keys, "left")


def track(pred: DataFrame, flights: DataFrame, date: str, *, late: float = 15.0) -> DataFrame:
    """Predictions of each of a day's flights 6, 3 and 1 hours ahead, with errors and status.

    A prediction is the one for a lead when its snapshot is the nearest to that lead;
    picking is one conditional aggregate per flight, with no join on snapshots.
    """
    day = on_date(flights, date).select(
        "flight_id", "ORIGIN", "DEST", "Operating_Airline", "Tail_Number", "dep_datetime", "arr_datetime", "ArrDelay")
    rows = pred.hint("merge").join(day, "flight_id")  # see replay.day: the log is larger than Spark thinks
    picks = [
        F.max(F.when(F.col("snapshot_time") == nearest_snapshot("dep_datetime", h), F.col("pred"))).alias(f"pred_{h}h")
        for h in LEADS
    ]
    keys = ["flight_id", "ORIGIN", "DEST", "Operating_Airline", "Tail_Number", "dep_datetime", "arr_datetime", "ArrDelay"]
    table = rows.groupBy(*keys).agg(*picks).where(" or ".join(f"pred_{h}h is not null" for h in LEADS))
    actual = F.col("ArrDelay")
    out = table.select(
        "flight_id", "ORIGIN", "DEST", F.col("Operating_Airline").alias("airline"), F.col("Tail_Number").alias("tail"),
        clock("dep_datetime").alias("sched_dep"), clock("arr_datetime").alias("sched_arr"),
        *[F.bround(f"pred_{h}h", 1).alias(f"pred_{h}h") for h in LEADS], F.bround(actual, 1).alias("actual_arr_delay"),
        *[F.bround(F.abs(F.col(f"pred_{h}h") - actual), 1).alias(f"error_{h}h") for h in LEADS],
        *[((F.col(f"pred_{h}h") >= late) == (actual >= late)).alias(f"caught_{h}h") for h in LEADS],
        F.coalesce(actual_status(actual), F.lit("-")).alias("status"),
    )
    return out


def horizon_accuracy(tracked: DataFrame) -> DataFrame:
    """Per lead: flights, MAE, RMSE, share of right late/on-time calls, bias."""
    cells = F.array(*[
        F.struct(F.lit(h).alias("lead_h"), F.col(f"error_{h}h").alias("e"), F.col(f"caught_{h}h").alias("c"),
                 (F.col(f"pred_{h}h") - F.col("actual_arr_delay")).alias("b")) for h in LEADS
    ])
    rows = tracked.where("actual_arr_delay is not null").select(F.explode(cells).alias("x")).select("x.*")
    return rows.where("e is not null").groupBy("lead_h").agg(
        F.count(F.lit(1)).alias("flights"), F.avg("e").alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        share(F.col("c")).alias("delay_accuracy"), F.avg("b").alias("bias"))


def status_distribution(tracked: DataFrame) -> DataFrame:
    counts = tracked.where("actual_arr_delay is not null").groupBy("status").agg(F.count(F.lit(1)).alias("flights"))
    total = F.sum("flights").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # six rows at most
    return counts.select("status", "flights", (F.col("flights") / total).alias("share"))


def early_catch(tracked: DataFrame, *, severe: float = 30.0, late: float = 15.0) -> DataFrame:
    """How many severe delays were already called late 6 hours ahead."""
    bad = F.col("actual_arr_delay") >= severe
    row = tracked.agg(F.count_if(bad).alias("severe"), F.count_if(bad & (F.col("pred_6h") >= late)).alias("caught"))
    return row.withColumn("catch_rate", F.try_divide(F.col("caught").cast("double"), F.col("severe").cast("double")))


def best_catches(tracked: DataFrame, *, severe: float = 30.0, late: float = 15.0, top: int = 10) -> DataFrame:
    return tracked.where((F.col("actual_arr_delay") >= severe) & (F.col("pred_6h") >= late)).orderBy("flight_id").limit(top)


def worst_misses(tracked: DataFrame, *, top: int = 10) -> DataFrame:
    return tracked.where("error_1h is not null").orderBy(F.desc("error_1h"), "flight_id").limit(top)


def convergence(tracked: DataFrame, *, late: float = 15.0) -> DataFrame:
    """MAE by lead of flights with all three predictions, late against on time."""
    complete = tracked.where(" and ".join(f"error_{h}h is not null" for h in LEADS))
    return complete.groupBy((F.col("actual_arr_delay") >= late).alias("was_late")).agg(
        F.count(F.lit(1)).alias("flights"), *[F.avg(f"error_{h}h").alias(f"mae_{h}h") for h in LEADS])


def point_requests(requests: DataFrame) -> DataFrame:
    """One row per (request, lead): snapshot time and hours to departure."""
    return requests.select("*", F.explode(F.array(*[F.lit(h) for h in LEADS])).alias("lead_h")).withColumns({
        "snapshot_time": add_minutes("dep_datetime", -60 * F.col("lead_h")),
        "confidence": F.when(F.col("lead_h") == 1, "High").when(F.col("lead_h") == 3, "Medium").otherwise("Low"),
    })


def point_features(requests: DataFrame) -> DataFrame:
    """Flight features of asked-for departures: only what is known without the aircraft.

    `requests` comes from `point_requests` over flights with hist_avg and hist_std; the
    leg counts as the tail's first and its origin as a hub.
    """
    hour_sin, hour_cos = cyclic(F.hour("dep_datetime"), 24)
    dow_sin, dow_cos = cyclic(F.weekday("dep_datetime"), 7)
    zeros = ["dep_delay_now", "turnaround", "inbound", "distance", "taxi_out_now", "carrier_delay_now",
             "arr_hour_sin", "arr_hour_cos", "cumul", "legs"]
    return requests.withColumns({
        "f_dep_hour_sin": hour_sin, "f_dep_hour_cos": hour_cos, "f_dow_sin": dow_sin, "f_dow_cos": dow_cos,
        "f_is_first": F.lit(1.0), "f_hub_origin": F.lit(1.0), "f_h2dep": F.least(F.col("lead_h") / 24, F.lit(1.0)),
        "f_hist_avg": clip(F.col("hist_avg") / 300.0, -1.0, 1.0), "f_hist_std": clip(F.col("hist_std") / 300.0, 0.0, 1.0),
        **{f"f_{c}": F.lit(0.0) for c in zeros},
    })


def predicted_arrival(dep: Column | str, pred: Column | str) -> Column:
    """Clock time of departure plus predicted delay, to the minute."""
    c = F.col(pred) if isinstance(pred, str) else pred
    return clock(add_minutes(dep, F.floor(c)))

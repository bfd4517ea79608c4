"""Aircraft rotation: successive legs of one tail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.expr import floor_hour, hours_between, minutes_between, rotation_risk, share
from skyledger.functions.sequence import along_key, exact_percentiles, with_row
from skyledger.operators.clean import between_airports

_NEXT = ["flight_id", "ORIGIN", "DEST", "dep_datetime", "arr_datetime", "DepDelay", "ArrDelay"]


def _usable(flights: DataFrame) -> DataFrame:
    return flights.dropna(subset=["Tail_Number", "dep_datetime", "arr_datetime"])


def next_legs(flights: DataFrame) -> DataFrame:
    """Each leg with the tail's next leg (null on the last one) and the gap between them.

    Flights clustered by tail and day (`layout.flights_by_tail`, column dep_day) are read as they lie and not exchanged.
    """
    clustered = "dep_day" in flights.columns
    legs = _usable(flights).select("Tail_Number", *_NEXT, *["dep_day"] * clustered)
    paired = along_key(
        legs, ["Tail_Number"], ["dep_datetime", "flight_id"], F.col("dep_day") if clustered else F.to_date("dep_datetime"), following=_NEXT)
    paired = paired.drop("dep_day")
    return paired.withColumn("gap_min", minutes_between("arr_datetime", "next_row.dep_datetime"))


def rotation_edges(flights: DataFrame, *, min_gap: float = 0, max_gap: float = 720) -> DataFrame:
    """Leg N to leg N+1 when the gap is in range and N+1 leaves where N arrived."""
    n = "next_row."
    pairs = next_legs(flights).where(
        F.col("gap_min").between(min_gap, max_gap) & (F.col("DEST") == F.col(n + "ORIGIN"))
    )
    turnaround = F.bround("gap_min", 2)
    return pairs.select(
        F.lit("rotation").alias("edge_type"), F.col("Tail_Number").alias("tail_number"),
        F.col("flight_id").alias("leg1_flight_id"), F.col(n + "flight_id").alias("leg2_flight_id"),
        F.col("ORIGIN").alias("src_airport"), F.col("DEST").alias("mid_airport"),
        F.col(n + "DEST").alias("dst_airport"), F.lit(True).alias("airport_match"),
        F.col("dep_datetime").alias("leg1_dep"), F.col("arr_datetime").alias("leg1_arr"),
        F.col(n + "dep_datetime").alias("leg2_dep"), F.col(n + "arr_datetime").alias("leg2_arr"),
        turnaround.alias("turnaround_min"),
        F.col("ArrDelay").alias("leg1_arr_delay"), F.col("DepDelay").alias("leg1_dep_delay"),
        F.col(n + "DepDelay").alias("leg2_dep_delay"), F.col(n + "ArrDelay").alias("leg2_arr_delay"),
        rotation_risk("ArrDelay", turnaround).alias("edge_weight"),
    )


def rotation_candidates(flights: DataFrame, *, max_gap_hours: float = 3.0) -> DataFrame:
    """Audit counts: legs, candidate pairs by gap alone, and how many match airports."""
    pairs = next_legs(flights)
    ok = F.col("gap_min").between(0, max_gap_hours * 60)
    counts = pairs.agg(
        F.count(F.lit(1)).alias("legs"), F.count_if(ok).alias("candidates"),
        F.count_if(ok & (F.col("DEST") == F.col("next_row.ORIGIN"))).alias("matching"),
        F.avg(F.when(ok, F.col("gap_min"))).alias("gap_mean"),
    )
    spread = exact_percentiles(pairs.where(ok), [], "gap_min", {"gap_p25": 0.25, "gap_median": 0.5, "gap_p75": 0.75})
    return with_row(counts, spread)


def rotation_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(
        F.count(F.lit(1)).alias("edges"), F.avg("turnaround_min").alias("turnaround_mean"),
        F.min("turnaround_min").alias("turnaround_min"), F.max("turnaround_min").alias("turnaround_max"),
        F.avg("edge_weight").alias("weight_mean"), F.stddev_samp("edge_weight").alias("weight_std"),
        F.count_if(F.col("leg1_arr_delay") > 15).alias("late_inbound"),
    )


def propagation_by_class(edges: DataFrame) -> DataFrame:
    """Mean departure delay of leg 2 by how late leg 1 arrived; classes overlap as defined."""
    d = F.col("leg1_arr_delay")
    classes = F.array_compact(F.array(
        F.when(d <= 0, F.lit("on_time")), F.when(d > 15, F.lit("delayed")), F.when(d > 60, F.lit("severe")),
    ))
    return edges.select(F.explode(classes).alias("leg1_class"), "leg2_dep_delay").groupBy("leg1_class").agg(
        F.avg("leg2_dep_delay").alias("mean_leg2_dep_delay"), F.count(F.lit(1)).alias("n")
    )


def propagation_by_turnaround(edges: DataFrame, bounds: tuple[int, ...] = (0, 30, 60, 90)) -> DataFrame:
    """Share of late second legs by turnaround, given a late first leg.

    A second leg without a known delay counts as not late, as in the source measure.
    """
    late1 = edges.where(F.col("leg1_arr_delay") > 15)
    bucket = F.lit(None).cast("string")
    for lo, hi in reversed(list(zip(bounds, bounds[1:]))):
        inside = (F.col("turnaround_min") >= lo) & (F.col("turnaround_min") < hi)
        bucket = F.when(inside, F.lit(f"{lo}-{hi}")).otherwise(bucket)
    return late1.withColumn("turnaround_bucket", bucket).where("turnaround_bucket is not null").groupBy(
        "turnaround_bucket"
    ).agg(
        share(F.coalesce(F.col("leg2_dep_delay") > 15, F.lit(False))).alias("propagated_share"),
        F.count(F.lit(1)).alias("n"),
    )


def tail_propagation(flights: DataFrame, *, max_gap_hours: float = 8.0, landed_only: bool = False) -> DataFrame:
    """Delay carried by the tail earlier the same day.

    Every flight gets cumul_delay (positive arrival delays of earlier legs),
    legs_done and immed_inbound (previous leg's arrival delay); all three are 0
    unless the previous leg exists, its delay is known and the gap is 0..max_gap_hours.
    `landed_only` also records the previous arrival for a landing check at snapshot time.
    """
    legs = flights.withColumn("__date", F.to_date("dep_datetime"))
    usable = F.col("Tail_Number").isNotNull() & F.col("dep_datetime").isNotNull() & F.col("arr_datetime").isNotNull()
    ordered = along_key(
        legs.where(usable), ["Tail_Number", "__date"], ["dep_datetime", "flight_id"], floor_hour("dep_datetime"),
        preceding=["arr_datetime", "ArrDelay"],
        totals={"__cumul": F.greatest(F.col("ArrDelay"), F.lit(0.0))}, position="__legs",
    )
    gap = hours_between("prev_row.arr_datetime", "dep_datetime")
    ok = F.col("prev_row").isNotNull() & gap.between(0, max_gap_hours) & F.col("prev_row.ArrDelay").isNotNull()
    zero = F.lit(0.0)
    out = ordered.withColumns({
        "cumul_delay": F.when(ok, F.col("__cumul")).otherwise(zero),
        "legs_done": F.when(ok, F.col("__legs")).otherwise(F.lit(0)).cast("long"),
        "immed_inbound": F.when(ok, F.col("prev_row.ArrDelay")).otherwise(zero),
    })
    names = [c for c in flights.columns]
    if landed_only:
        out = out.withColumn("inbound_arr", F.when(ok, F.col("prev_row.arr_datetime")))
        names = names + ["inbound_arr"]
    done = out.select(*names, "cumul_delay", "legs_done", "immed_inbound")
    rest = legs.where(~usable | usable.isNull()).withColumns({
        "cumul_delay": zero, "legs_done": F.lit(0).cast("long"), "immed_inbound": zero,
    })
    if landed_only:
        rest = rest.withColumn("inbound_arr", F.lit(None).cast("timestamp_ntz"))
    return done.unionByName(rest.select(*done.columns))


def by_hour(edges: DataFrame, airports: DataFrame) -> DataFrame:
    """Airport-to-airport rotation edges per departure hour of leg 2."""
    known = between_airports(edges, airports, "src_airport", "mid_airport")
    return known.select(
        floor_hour("leg2_dep").alias("snapshot_time"), "src_airport", F.col("mid_airport").alias("dst_airport"),
        (F.greatest(F.lit(0.0), F.least(F.lit(90.0), F.col("turnaround_min"))) / 90).alias("turnaround_norm"),
    )

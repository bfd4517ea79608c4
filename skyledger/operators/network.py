"""Delay-correlation network between airports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.expr import floor_hour
from skyledger.plans.staging import stage

BLOCKS = 64  # airports are dealt into so many blocks by hash; one row forms the products of two blocks in one hour


def hourly_delay(flights: DataFrame) -> DataFrame:
    """Mean departure delay per (hour, airport); hours without a known delay stay as null."""
    return flights.where("ORIGIN is not null and dep_datetime is not null").groupBy(
        floor_hour("dep_datetime").alias("dep_hour"), F.col("ORIGIN").alias("airport")
    ).agg(F.avg("DepDelay").alias("delay"))


def correlations(hourly: DataFrame, *, blocks: int = BLOCKS) -> DataFrame:
    """a < b, r: the Pearson correlation of every pair of airports over all hours, a missing hour counting as 0.

    `hourly` holds one row per (dep_hour, airport). Zeros add nothing to a sum of products, so only hours in which both airports
    have a value count: their products are summed by pair in one aggregation, which combines before its exchange. Airports that share no
    hour meet in one hour of zeros, added for all. A constant airport has no correlation and no pairs.
    """
    known = stage(hourly.select("dep_hour", "airport", F.coalesce("delay", F.lit(0.0)).alias("x")), "hourly-delay")
    n = known.agg(F.count_distinct("dep_hour")).scalar()
    zero = F.when(F.col("k") < F.col("n"), F.lit(0.0))  # a missing hour is one more value, 0
    per = known.groupBy("airport").agg(
        F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"), F.count(F.lit(1)).alias("k"), F.min("x").alias("low"),
        F.max("x").alias("high")).withColumn("n", n).where(F.least("low", zero) < F.greatest("high", zero))
    per = stage(per.select("airport", "s", (F.col("n") * F.col("ss") - F.col("s") * F.col("s")).alias("v"), "n"), "airport-sums")

    values = known.unionByName(per.select(F.lit(None).cast("timestamp_ntz").alias("dep_hour"), "airport", F.lit(0.0).alias("x")))
    block = F.pmod(F.xxhash64("airport"), F.lit(blocks))
    rows = values.groupBy("dep_hour", block.alias("block")).agg(F.collect_list(F.struct("airport", "x")).alias("in_block"))
    rows = rows.groupBy("dep_hour").agg(F.collect_list(F.struct("block", "in_block")).alias("all"))  # an hour's airports, no more
    two = rows.select("all", F.explode("all").alias("p")).select("p", F.explode("all").alias("q")).where("p.block <= q.block")
    pair = two.select(F.explode("p.in_block").alias("a"), "q").select("a", F.explode("q.in_block").alias("b"))
    ordered = pair.where("a.airport <> b.airport").select(
        F.least("a.airport", "b.airport").alias("a"), F.greatest("a.airport", "b.airport").alias("b"), (F.col("a.x") * F.col("b.x")).alias("xy"),
        (F.col("a.airport") < F.col("b.airport")).alias("up"))
    # Inside one block a pair is met both ways round; across blocks once, in either order.
    same = F.pmod(F.xxhash64("a"), F.lit(blocks)) == F.pmod(F.xxhash64("b"), F.lit(blocks))
    products = ordered.where(F.col("up") | ~same).groupBy("a", "b").agg(F.sum("xy").alias("xy"))
    side = lambda c: per.select(F.col("airport").alias(c), F.col("s").alias(f"s_{c}"), F.col("v").alias(f"v_{c}"), *(["n"] if c == "a" else []))
    return products.join(side("a"), "a").join(side("b"), "b").select(
        "a", "b", ((F.col("n") * F.col("xy") - F.col("s_a") * F.col("s_b")) / F.sqrt(F.col("v_a") * F.col("v_b"))).alias("r"))


def network_edges(flights: DataFrame, *, min_r: float = 0.30) -> DataFrame:
    """Ordered airport pairs whose hourly mean delays correlate at `min_r` or more."""
    found = correlations(hourly_delay(flights)).where(F.col("r") >= min_r)
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return found.select("r", F.explode(ends).alias("e")).select(
        F.lit("network").alias("edge_type"), F.col("e.src").alias("src_airport"), F.col("e.dst").alias("dst_airport"),
        F.bround("r", 4).alias("correlation"), F.bround(F.least(F.lit(1.0), F.col("r")), 4).alias("edge_weight"))

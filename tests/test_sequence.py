"""A key that is cut into slots gives the same neighbours, totals and positions as one window."""
from pyspark.sql import Window, functions as F

from skyledger.functions.sequence import along_key, exact_percentiles

def skewed(spark):
    """One key with a third of all rows, the rest small; equal times within the hot key."""
    i = F.col("id")
    return spark.range(3000).select(
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (i % 40).cast("string"))).alias("k"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.pmod(F.xxhash64(i), F.lit(400))).cast("int"))).alias("t"),
        i.alias("n"), (i % 7).cast("double").alias("x"))


def test_hot_keys_equal_plain_window(spark):
    df = skewed(spark)
    got = along_key(df, ["k"], ["t", "n"], F.date_trunc("minute", "t"), following=["n"], preceding=["n", "x"], totals={"s": F.col("x")}, position="p")
    w = Window.partitionBy("k").orderBy("t", "n")
    want = df.select(
        "k", "n", F.lead("n").over(w).alias("nx"), F.lag("n").over(w).alias("pn"), F.lag("x").over(w).alias("px"),
        F.coalesce(F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("s"), (F.row_number().over(w) - 1).alias("p"))
    a = {tuple(r) for r in got.select("k", "n", "next_row.n", "prev_row.n", "prev_row.x", "s", "p").collect()}
    assert a == {tuple(r) for r in want.collect()}


def test_many_rows_at_one_time(spark):
    """A third of all rows under one key, all at the same moment but two."""
    i = F.col("id")
    df = spark.range(900).select(
        F.when(i % 3 == 0, "hot").otherwise(i.cast("string")).alias("k"), i.alias("n"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.when(i == 0, -1).when(i == 897, 1).otherwise(0))).alias("t"))
    got = along_key(df, ["k"], ["t", "n"], F.to_date("t"), following=["n"], position="p").where("k = 'hot'").orderBy("p").collect()
    assert [r.n for r in got] == list(range(0, 900, 3)) and [r.next_row.n if r.next_row else None for r in got] == [*range(3, 900, 3), None]


def test_raw_rows_are_exchanged_once_by_key_and_slot(spark):
    out = along_key(skewed(spark), ["k"], ["t", "n"], F.date_trunc("minute", "t"), following=["n"], preceding=["x"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert sum("__slot" in line for line in exchanges) <= 2  # the rows, and their partly aggregated summaries
    assert plan.count("Window") >= 2 and "CartesianProduct" not in plan


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 2, 10)] + [("b", 5.0), ("b", None)], "k string, v double")
    got = {r.k: (r.m, r.p) for r in exact_percentiles(df, ["k"], "v", {"m": 0.5, "p": 0.9}).collect()}
    assert got["a"][0] == 2.0 and abs(got["a"][1] - 6.8) < 1e-9 and got["b"] == (5.0, 5.0)

"""Data-quality checks as tables: (name, status, detail), status pass / warn / fail.

Each group of checks is one aggregate pass; the check rows are derived from its single row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.expr import minutes_between, pearson, share, us_tail
from skyledger.functions.sequence import exact_percentiles, with_row
from skyledger.operators.clean import between_airports
from skyledger.sources.flights import path_exists
from skyledger.sources.weather import list_files

REQUIRED = ["ORIGIN", "DEST", "DepDelay", "ArrDelay", "dep_datetime", "arr_datetime", "Tail_Number"]


def check(name: str, condition: Column, detail: Column, *, warn_only: bool = False) -> Column:
    status = F.when(F.coalesce(condition, F.lit(False)), "pass").otherwise("warn" if warn_only else "fail")
    return F.struct(F.lit(name).alias("name"), status.alias("status"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))


def as_rows(row: DataFrame, checks: Sequence[Column]) -> DataFrame:
    return row.select(F.explode(F.array(*checks)).alias("c")).select("c.name", "c.status", "c.detail")


def summary(checks: DataFrame) -> DataFrame:
    return checks.agg(
        *[F.count_if(F.col("status") == s).alias(n) for s, n in (("pass", "passed"), ("fail", "failed"), ("warn", "warned"))],
        F.count(F.lit(1)).alias("total"))


def _fmt(pattern: str, *cols: Column) -> Column:
    return F.format_string(pattern, *cols)


def basics(
    flights: DataFrame, *, rows: tuple[int, int] = (5_000_000, 30_000_000), years: tuple[int, int] = (2018, 2022)
) -> DataFrame:
    """Row count, required columns, year range, and null rates graded at 5 and 15 percent."""
    return as_rows(flights.agg(*_basic_metrics(flights)), _basic_checks(flights.columns, rows, years))


def _graded(columns: Sequence[str]) -> list[str]:
    return [c for c in ("DepDelay", "ArrDelay", "Tail_Number", "dep_datetime", "arr_datetime") if c in columns]


def _basic_metrics(flights: DataFrame) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.min(F.year("dep_datetime")).alias("y0"), F.max(F.year("dep_datetime")).alias("y1"),
            *[share(F.col(c).isNull()).alias(f"null_{c}") for c in _graded(flights.columns)]]


def _basic_checks(columns: Sequence[str], rows: tuple[int, int], years: tuple[int, int]) -> list[Column]:
    missing, graded = [c for c in REQUIRED if c not in columns], _graded(columns)
    checks = [
        check("Row count reasonable", (F.col("n") > rows[0]) & (F.col("n") < rows[1]), _fmt("%d rows", F.col("n"))),
        check("Required columns present", F.lit(not missing), F.lit(", ".join(missing))),
        check("Year range", (F.col("y0") == years[0]) & (F.col("y1") == years[1]), _fmt("%d to %d", F.col("y0"), F.col("y1"))),
    ]
    for c in graded:
        rate = F.col(f"null_{c}")
        grade = F.when(rate < 0.05, "pass").when(rate < 0.15, "warn").otherwise("fail")
        checks.append(F.struct(F.lit(f"Null rate {c}").alias("name"), grade.alias("status"),
                               _fmt("%.1f%%", rate * 100).alias("detail")))
    return checks


def flights_per_year(flights: DataFrame) -> DataFrame:
    return flights.groupBy(F.year("dep_datetime").alias("year")).agg(F.count(F.lit(1)).alias("flights"))


def delay_profile(flights: DataFrame) -> DataFrame:
    """One row of arrival-delay statistics, shares and the departure/arrival correlation."""
    row = flights.agg(*_delay_metrics())
    points = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    q = exact_percentiles(flights, [], "ArrDelay", points)
    return with_row(row, q)


def _delay_metrics() -> list[Column]:
    a = F.col("ArrDelay")
    return [
        F.count(a).alias("n"), F.avg(a).alias("mean"), F.stddev_samp(a).alias("std"), F.min(a).alias("min"), F.max(a).alias("max"),
        share(a < 0).alias("share_early"), share(a < -200).alias("share_below_200"), F.count_if(a < -200).alias("below_200"),
        share(a >= 15).alias("share_15"), share(a >= 60).alias("share_60"), F.count_if(a > 15).alias("late_15"),
        pearson("DepDelay", "ArrDelay").alias("dep_arr_corr")]


def delays(flights: DataFrame) -> DataFrame:
    return as_rows(delay_profile(flights), _delay_checks())


def _delay_checks() -> list[Column]:
    p = F.col
    return [
        check("ArrDelay mean between 0 and 20 min", p("mean").between(0, 20), _fmt("%.1f", p("mean"))),
        check("ArrDelay has early arrivals", p("share_early") > 0.3, _fmt("%.1f%%", p("share_early") * 100)),
        check("ArrDelay max below 2000", p("max") < 2000, _fmt("%.0f", p("max")), warn_only=True),
        check("No delays below -200 min", p("share_below_200") < 0.001, _fmt("%d flights", p("below_200")), warn_only=True),
        check("Share late by 15 min between 10 and 35 percent", (p("share_15") * 100).between(10, 35), _fmt("%.1f%%", p("share_15") * 100)),
        check("DepDelay and ArrDelay correlated", p("dep_arr_corr") > 0.7, _fmt("%.3f", p("dep_arr_corr"))),
    ]


def airports(
    flights: DataFrame, expected: DataFrame, *, min_rows: int = 8_000_000, min_per_airport: int = 10_000
) -> DataFrame:
    """Coverage of the expected airports, a table with column `airport` such as `sources.airports.airports`."""
    per = between_airports(flights, expected).groupBy(F.col("ORIGIN").alias("airport")).agg(F.count(F.lit(1)).alias("n"))
    both = expected.select("airport").distinct().join(per, "airport", "left")
    row = both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n").isNull()).alias("missing"),
        F.min("n").alias("least"), F.min_by("airport", F.struct("n", "airport")).alias("least_airport"))
    return as_rows(row, [
        check("Rows between expected airports", F.col("rows") > min_rows, _fmt("%d rows", F.col("rows"))),
        check("All expected airports appear as origins", F.col("missing") == 0, _fmt("%d missing", F.col("missing"))),
        check("No airport has few flights", F.col("least") > min_per_airport, _fmt("%d", F.col("least"))),
    ])


def busiest_routes(flights: DataFrame, top: int = 10) -> DataFrame:
    return flights.where("ORIGIN is not null and DEST is not null").groupBy("ORIGIN", "DEST").agg(
        F.count(F.lit(1)).alias("flights")).orderBy(F.desc("flights"), "ORIGIN", "DEST").limit(top)


def airport_ends(flights: DataFrame, top: int = 5) -> DataFrame:
    """The `top` busiest and quietest origins."""
    per = flights.where("ORIGIN is not null").groupBy("ORIGIN").agg(F.count(F.lit(1)).alias("flights"))
    most = per.orderBy(F.desc("flights"), "ORIGIN").limit(top).withColumn("side", F.lit("top"))
    least = per.orderBy("flights", "ORIGIN").limit(top).withColumn("side", F.lit("bottom"))
    return most.unionByName(least)


def tail_profile(flights: DataFrame) -> DataFrame:
    """Distinct tails, null rate, registration format, and legs per tail and day."""
    per_day = flights.where("Tail_Number is not null").groupBy("Tail_Number", F.to_date("dep_datetime").alias("day")).agg(
        F.count(F.lit(1)).alias("legs"))
    legs = per_day.where("day is not null").agg(
        F.avg("legs").alias("legs_mean"), F.max("legs").alias("legs_max"), F.count_if(F.col("legs") > 6).alias("over_6"))
    median = exact_percentiles(per_day.where("day is not null"), [], "legs", {"legs_median": 0.5})
    row = flights.agg(
        F.count_distinct("Tail_Number").alias("tails"), share(F.col("Tail_Number").isNull()).alias("null_rate"),
        share(us_tail("Tail_Number")).alias("us_format"))
    return with_row(with_row(row, legs), median)


def tails(flights: DataFrame, *, distinct: tuple[int, int] = (3000, 20000)) -> DataFrame:
    p = F.col
    return as_rows(tail_profile(flights), [
        check("Tail null rate below 5 percent", p("null_rate") < 0.05, _fmt("%.1f%%", p("null_rate") * 100)),
        check("Reasonable number of tails", (p("tails") > distinct[0]) & (p("tails") < distinct[1]), _fmt("%d", p("tails"))),
        check("Tails look like US registrations", p("us_format") > 0.8, _fmt("%.1f%%", p("us_format") * 100)),
        check("Median legs per tail and day between 2 and 5", p("legs_median").between(2, 5), _fmt("%.1f", p("legs_median"))),
    ])


def duration_profile(flights: DataFrame) -> DataFrame:
    d = minutes_between("dep_datetime", "arr_datetime")
    return flights.where("dep_datetime is not null and arr_datetime is not null").select(d.alias("d")).agg(
        F.count("d").alias("n"), F.avg("d").alias("mean"), F.min("d").alias("min"), F.max("d").alias("max"),
        F.count_if(F.col("d") < 0).alias("negative"), F.count_if(F.col("d") < 30).alias("short"),
        F.count_if(F.col("d") > 600).alias("long"))


def monthly_delay(flights: DataFrame) -> DataFrame:
    return flights.where("dep_datetime is not null").groupBy(F.month("dep_datetime").alias("month")).agg(
        F.avg("ArrDelay").alias("mean_arr_delay"), F.count(F.lit(1)).alias("flights"))


def temporal(flights: DataFrame) -> DataFrame:
    season = F.when(F.col("month").isin(6, 7, 8), "summer").when(F.col("month").isin(12, 1, 2), "winter")
    by = monthly_delay(flights).withColumn("season", season)
    mean = lambda s: F.avg(F.when(F.col("season") == s, F.col("mean_arr_delay")))
    seasons = by.agg(mean("summer").alias("summer"), mean("winter").alias("winter"))
    row = with_row(duration_profile(flights), seasons)
    return as_rows(row, _temporal_checks())


def _temporal_checks() -> list[Column]:
    p = F.col
    return [
        check("No negative durations", p("negative") / p("n") < 0.001, _fmt("%d", p("negative")), warn_only=True),
        check("Mean duration between 90 and 200 min", p("mean").between(90, 200), _fmt("%.0f", p("mean"))),
        check("Summer delays above winter", p("summer") > p("winter"), _fmt("%.1f / %.1f", p("summer"), p("winter")), warn_only=True),
    ]


# ---------------------------------------------------------------- checks taken on the way


def watched(flights: DataFrame, name: str = "flights") -> tuple[DataFrame, Observation]:
    """The same rows, and what is observed of them while they are written: the metrics of `basics`, `delays` and `temporal` in no pass of their own.

    Take the flights from `spark.newSession()`: in Spark 4.1 a session that has observed something can no longer be carried into tasks, which
    Spark ML does.
    """
    d = minutes_between("dep_datetime", "arr_datetime")
    month = F.month("dep_datetime")
    metrics = [*_basic_metrics(flights), *[m.alias(f"delay_{n}") for m, n in _named(_delay_metrics())],
               F.count(d).alias("dur_n"), F.avg(d).alias("dur_mean"), F.count_if(d < 0).alias("dur_negative"),
               *[F.avg(F.when(month == k, F.col("ArrDelay"))).alias(f"month_{k}") for k in range(1, 13)]]
    seen = Observation(name)
    return flights.observe(seen, *metrics), seen


def _named(metrics: Sequence[Column]) -> list[tuple[Column, str]]:
    names = ["n", "mean", "std", "min", "max", "share_early", "share_below_200", "below_200", "share_15", "share_60", "late_15", "dep_arr_corr"]
    return list(zip(metrics, names, strict=True))


def observed_metrics(spark: SparkSession, seen: Observation) -> DataFrame:
    """One row of what was observed; waits for the write to end."""
    return spark.range(1).select(*[F.lit(v).cast("long" if isinstance(v, int) else "double").alias(k) for k, v in seen.get.items()])


def observed(spark: SparkSession, seen: Observation, columns: Sequence[str], *, rows: tuple[int, int] = (5_000_000, 30_000_000),
             years: tuple[int, int] = (2018, 2022)) -> DataFrame:
    """The checks of `basics`, `delays` and `temporal` from an observation."""
    row = observed_metrics(spark, seen)
    part = lambda prefix: row.select(*[F.col(c).alias(c.removeprefix(prefix)) for c in row.columns if c.startswith(prefix)])
    months = lambda *ks: F.array_compact(F.array(*[F.col(f"month_{k}").cast("double") for k in ks]))
    mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda x, y: x + y), F.size(a))
    seasons = row.select(F.col("dur_n").alias("n"), F.col("dur_mean").alias("mean"), F.col("dur_negative").alias("negative"),
                         mean(months(6, 7, 8)).alias("summer"), mean(months(12, 1, 2)).alias("winter"))
    return as_rows(row, _basic_checks(columns, rows, years)).unionByName(as_rows(part("delay_"), _delay_checks())).unionByName(
        as_rows(seasons, _temporal_checks()))


# ---------------------------------------------------------------- distinct counts that add up


def day_sketches(flights: DataFrame, columns: Sequence[str], *, time: str = "dep_datetime", log2_registers: int = 14) -> DataFrame:
    """Per day one sketch of the distinct values of each column: a few KB a day whatever its rows, merged for any range of days.

    The standard error is 1.04 / sqrt(2^log2_registers), 0.8 % by default.
    """
    return flights.groupBy(F.to_date(time).alias("day")).agg(*[F.hll_sketch_agg(c, log2_registers).alias(c) for c in columns])


def distinct_by(sketches: DataFrame, period: Column, columns: Sequence[str], name: str = "period") -> DataFrame:
    """Estimated distinct values per period (any expression of `day`), from the days' sketches alone."""
    return sketches.groupBy(period.alias(name)).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])


# Tables a finished build must hold, and their least row counts.
ARTIFACTS = {
    "rotation_edges": 10_000_000, "congestion_edges": 5_000, "airport_locations": 30, "network_edges": 1_000,
    "flight_lookup": 5_000_000, "airport_snapshots": 1, "flight_snapshots": 1,
}


def artifacts(spark: SparkSession, root: str, expected: Mapping[str, int] = ARTIFACTS) -> DataFrame:
    """Existence and row count of the written tables (counts come from parquet footers)."""
    parts, absent = [], []
    for name, least in expected.items():
        path = f"{root.rstrip('/')}/{name}"
        if path_exists(spark, path):
            row = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))
            parts.append(as_rows(row, [check(f"{name} has enough rows", F.col("n") >= least, _fmt("%d rows", F.col("n")))]))
        else:
            absent.append((f"{name} exists", "fail", f"not found: {path}"))
    if absent:
        parts.append(spark.createDataFrame(absent, "name string, status string, detail string"))
    return reduce(DataFrame.unionByName, parts)


def same_rows(raw: DataFrame, enriched: DataFrame) -> DataFrame:
    row = raw.agg(F.count(F.lit(1)).alias("a")).select("a", enriched.agg(F.count(F.lit(1)).alias("b")).select("b").scalar().alias("b"))
    return as_rows(row, [check("Raw and enriched row counts equal", F.col("a") == F.col("b"), _fmt("%d / %d", F.col("a"), F.col("b")))])


def rotation_profile(edges: DataFrame) -> DataFrame:
    t = F.col("turnaround_min")
    row = edges.agg(
        F.count(F.lit(1)).alias("edges"), F.avg(t).alias("mean"), share(t < 20).alias("share_20"), share(t < 45).alias("share_45"),
        share(F.coalesce(F.col("leg1_arr_delay") > 15, F.lit(False))).alias("share_late_inbound"))
    q = exact_percentiles(edges, [], "turnaround_min", {"median": 0.5})
    return with_row(row, q)


def rotation(edges: DataFrame) -> DataFrame:
    p = F.col
    return as_rows(rotation_profile(edges), [
        check("Mean turnaround above 30 min", p("mean") > 30, _fmt("%.1f", p("mean"))),
        check("Rotation edges carry delay", p("share_late_inbound") > 0.05, _fmt("%.1f%%", p("share_late_inbound") * 100)),
    ])


def run(flights: DataFrame, edges: DataFrame, expected: DataFrame) -> DataFrame:
    """All checks on flights and rotation edges as one table."""
    return reduce(DataFrame.unionByName, [
        basics(flights), delays(flights), airports(flights, expected), tails(flights), temporal(flights), rotation(edges)])


# ---------------------------------------------------------------- audits


def audit(flights: DataFrame) -> DataFrame:
    """Dates and distinct counts; airports are counted over both ends together."""
    row = flights.agg(
        F.min("dep_datetime").alias("first_dep"), F.max("dep_datetime").alias("last_dep"), F.count(F.lit(1)).alias("rows"),
        F.count_distinct("ORIGIN").alias("origins"), F.count_distinct("DEST").alias("destinations"),
        F.count_distinct("Operating_Airline").alias("airlines"), F.count_distinct("Tail_Number").alias("tails"))
    both = flights.select(F.explode(F.array("ORIGIN", "DEST")).alias("a")).where("a is not null").distinct().agg(
        F.count(F.lit(1)).alias("airports"))
    return with_row(row, both)


def missing_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing, share) of every column, from one pass."""
    names = [c for c in (columns or df.columns) if c in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in names])
    return row.select(F.explode(cells).alias("x"), "__rows").select(
        "x.column", "x.missing", F.try_divide(F.col("x.missing").cast("double"), F.col("__rows").cast("double")).alias("share"))


def schema_profile(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields], "column string, type string, nullable boolean")


def date_profile(df: DataFrame, column: str = "dep_datetime") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(column).alias("first"), F.max(column).alias("last"),
                  F.count_distinct(F.to_date(column)).alias("dates"), F.count_if(F.col(column).isNull()).alias("missing"))


def weather_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Airport x year, true where a file exists."""
    files = list_files(spark, folder).where("airport is not null")
    return files.groupBy("airport").pivot("file_year").agg(F.lit(True)).na.fill(False)


def misnamed_files(spark: SparkSession, folder: str) -> DataFrame:
    return list_files(spark, folder).where("airport is null").select("path")


def weather_coverage(flight_airports: DataFrame, weather_airports: DataFrame) -> DataFrame:
    """Airports with flights and weather, flights only, weather only."""
    f, w = flight_airports.select("airport").distinct(), weather_airports.select("airport").distinct()
    with_flag = f.withColumn("f", F.lit(True)).join(w.withColumn("w", F.lit(True)), "airport", "full_outer")
    kind = F.when(F.col("f") & F.col("w"), "both").when(F.col("f"), "flights_only").otherwise("weather_only")
    return with_flag.select("airport", kind.alias("coverage"))

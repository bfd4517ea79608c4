"""From raw on-time records to the flights table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.conform import ISO_FORMATS, conform, parse_timestamp
from skyledger.functions.expr import add_minutes, floor_hour, hhmm_minutes
from skyledger.plans.staging import new_folder, stage
from skyledger.sources.schemas import FLIGHTS, MONTHLY_NAMES, RAW_YEARLY

# Tail numbers that stand for "unknown".
PLACEHOLDER_TAILS = ["UNKNOW", "00000", "BLOCKED", ""]


def flown(raw: DataFrame, rule: str = "not_true") -> DataFrame:
    """Drop cancelled and diverted legs.

    not_true: a missing flag keeps the row; zero_with_tail: both flags must be 0 and
    the tail known; cancelled_only: only the cancelled flag counts.
    """
    def flag(name):
        if name not in raw.columns:
            return F.lit(None).cast("double")
        text = F.lower(F.trim(F.col(name).cast("string")))
        return F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))

    cancelled, diverted = flag("Cancelled"), flag("Diverted")
    if rule == "not_true":
        return raw.where((F.coalesce(cancelled, F.lit(0.0)) != 1) & (F.coalesce(diverted, F.lit(0.0)) != 1))
    if rule == "zero_with_tail":
        return raw.where((cancelled == 0) & (diverted == 0) & F.col("Tail_Number").isNotNull())
    if rule == "cancelled_only":
        return raw.where(F.coalesce(cancelled, F.lit(0.0)) != 1)
    raise ValueError(f"unknown rule {rule!r}")


def with_times(raw: DataFrame, dep: str, arr: str, policy: str = "clamp") -> DataFrame:
    """dep_datetime and arr_datetime from the date and HHMM numbers; an arrival before
    the departure belongs to the next day."""
    day = F.col("FlightDate").cast("timestamp_ntz")
    out = raw.withColumns({
        "dep_datetime": add_minutes(day, hhmm_minutes(dep, policy)),
        "arr_datetime": add_minutes(day, hhmm_minutes(arr, policy)),
    })
    late = F.col("arr_datetime") < F.col("dep_datetime")
    return out.withColumn(
        "arr_datetime", F.when(late, add_minutes("arr_datetime", 24 * 60)).otherwise(F.col("arr_datetime"))
    )


def flights(raw: DataFrame, *, hhmm_policy: str = "clamp", time_basis: str = "actual") -> DataFrame:
    """Yearly files to the flights table (without flight_id).

    `time_basis` "actual" takes the flown clock times, "scheduled" the planned ones.
    """
    dep, arr = {"actual": ("DepTime", "ArrTime"), "scheduled": ("CRSDepTime", "CRSArrTime")}[time_basis]
    kept = conform(flown(raw, "not_true"), RAW_YEARLY)
    dated = kept.withColumn("FlightDate", parse_timestamp("FlightDate", ISO_FORMATS).cast("date"))
    timed = with_times(dated, dep, arr, hhmm_policy)
    named = timed.withColumnsRenamed({"Origin": "ORIGIN", "Dest": "DEST"})
    return _table(_known(named))


def flights_strict(raw: DataFrame) -> DataFrame:
    """The stricter variant: both flags 0, tail known, and rows with an invalid clock dropped."""
    kept = conform(flown(raw, "zero_with_tail"), RAW_YEARLY)
    dated = kept.withColumn("FlightDate", parse_timestamp("FlightDate", ISO_FORMATS).cast("date"))
    timed = with_times(dated, "DepTime", "ArrTime", "strict").dropna(subset=["dep_datetime", "arr_datetime"])
    named = timed.withColumnsRenamed({"Origin": "ORIGIN", "Dest": "DEST"})
    return _table(named).withColumn("weather_time", floor_hour("dep_datetime"))


def flights_monthly(raw: DataFrame) -> DataFrame:
    """Monthly files: other header, clipping clock, cancelled legs dropped, causes of delay kept."""
    named = raw.withColumnsRenamed({k: v for k, v in MONTHLY_NAMES.items() if k in raw.columns})
    dated = named.withColumn("FlightDate", parse_timestamp("FlightDate", ISO_FORMATS).cast("date"))
    timed = with_times(flown(dated, "cancelled_only"), "DEP_TIME", "ARR_TIME", "clip")
    causes = ["CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay"]
    kept = timed.dropna(subset=["ORIGIN", "DEST", "Tail_Number"])
    extra = [F.col(c).try_cast("double").alias(c) for c in causes if c in kept.columns and c != "CarrierDelay"]
    return _table(kept, extra)


def _known(df: DataFrame) -> DataFrame:
    keys = ["Tail_Number", "ORIGIN", "DEST", "dep_datetime", "arr_datetime"]
    return df.dropna(subset=keys).where(~F.col("Tail_Number").isin(PLACEHOLDER_TAILS))


def _table(df: DataFrame, extra: Sequence = ()) -> DataFrame:
    day = F.col("FlightDate")
    calendar = {"Year": F.year(day), "Month": F.month(day), "DayofMonth": F.dayofmonth(day), "DayOfWeek": F.weekday(day) + 1}
    for name, known in calendar.items():
        given = F.col(name).try_cast("int") if name in df.columns else F.lit(None).cast("int")
        df = df.withColumn(name, F.coalesce(given, known))
    names = [f.name for f in FLIGHTS.fields if f.name != "flight_id"]
    schema = type(FLIGHTS)([f for f in FLIGHTS.fields if f.name in names])
    return conform(df, schema, keep_extra=bool(extra)).select(*names, *extra)


def with_calendar(df: DataFrame) -> DataFrame:
    """Hour starts, date, hour, month and weekday (0 = Monday) of departure and arrival."""
    dep, arr = F.col("dep_datetime"), F.col("arr_datetime")
    return df.withColumns({
        "dep_hour": floor_hour(dep), "arr_hour": floor_hour(arr), "flight_date": F.to_date(dep),
        "hour_of_day": F.hour(dep), "arr_hour_of_day": F.hour(arr), "month": F.month(dep),
        "dow": F.weekday(dep),
    })


def assign_flight_id(
    df: DataFrame, order: Sequence[str] = ("dep_datetime", "Tail_Number", "ORIGIN", "DEST", "arr_datetime")
) -> DataFrame:
    """flight_id = position in departure order, 0-based, written once.

    Rows are range-partitioned and sorted in the JVM and written with their position
    inside the partition; the offsets are the running sum of partition sizes (one row
    per partition). No row passes through Python and no window spans the table. The
    input is written first: its scan order then breaks ties, so copies of one row are
    spread over partitions and keep their place when a task is repeated.
    """
    spark = df.sparkSession
    written = stage(df, "unnumbered").withColumn("__row", F.monotonically_increasing_id())
    ties = [F.xxhash64(*df.columns), "__row"]
    ordered = written.repartitionByRange(*order, *ties).sortWithinPartitions(*order, *ties).drop("__row")
    spot = F.monotonically_increasing_id()  # partition number in the upper bits, position in the lower 33
    path = new_folder(spark, "flight-id")
    ordered.withColumn("__at", spot).write.parquet(path)
    done = spark.read.parquet(path).withColumns({
        "__part": F.shiftrightunsigned("__at", 33), "__pos": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)),
    })
    sizes = done.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    # One row per written partition: broadcast size is the partition count.
    numbered = done.join(F.broadcast(offsets), "__part")
    return numbered.select(
        (F.col("__base") + F.col("__pos")).alias("flight_id"), *[c for c in df.columns if c != "flight_id"]
    )


def between_airports(df: DataFrame, airports: DataFrame, src: str = "ORIGIN", dst: str = "DEST") -> DataFrame:
    """Rows whose two ends are both on the airport list."""
    known = airports.select("airport").distinct()
    return df.join(known.withColumnRenamed("airport", src), src, "left_semi").join(
        known.withColumnRenamed("airport", dst), dst, "left_semi"
    ).select(*df.columns)


def year_split(ts: str, train: Sequence[int], val: Sequence[int], test: Sequence[int]):
    year = F.year(ts)
    return F.when(year.isin(*train), "train").when(year.isin(*val), "val").when(year.isin(*test), "test")


def date_split(ts: str, val_from: str, test_from: str):
    day = F.to_date(ts)
    return (
        F.when(day < F.lit(val_from).cast("date"), "train").when(day < F.lit(test_from).cast("date"), "val")
        .when(day.isNotNull(), "test")
    )


def on_date(df: DataFrame, date: str, column: str = "dep_datetime") -> DataFrame:
    """Rows of one day, as a range on the column so that file statistics can prune."""
    start = F.lit(date).cast("date").cast("timestamp_ntz")
    return df.where((F.col(column) >= start) & (F.col(column) < add_minutes(start, 24 * 60)))


def available_dates(df: DataFrame, column: str = "dep_datetime") -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.to_date(column).alias("date")).agg(
        F.count(F.lit(1)).alias("rows"))


def flight_lookup(flights: DataFrame) -> DataFrame:
    return flights.select(
        "flight_id", "ORIGIN", "DEST", "dep_datetime", "arr_datetime", "Tail_Number", "Operating_Airline",
        *[c for c in ("Flight_Number_Operating_Airline",) if c in flights.columns],
    )


def tail_index(flights: DataFrame) -> DataFrame:
    """(Tail_Number, tail_id): sorted, from 1; 0 is kept for unknown tails."""
    tails = flights.where("Tail_Number is not null and Tail_Number <> ''").select("Tail_Number").distinct()
    return assign_flight_id(tails, ["Tail_Number"]).select(
        "Tail_Number", (F.col("flight_id") + 1).alias("tail_id")
    )


def with_tail_id(flights: DataFrame, index: DataFrame) -> DataFrame:
    return flights.join(index, "Tail_Number", "left").withColumn("tail_id", F.coalesce("tail_id", F.lit(0)))


def airport_index(airports: DataFrame) -> DataFrame:
    """(airport, node_idx) in code order. A dimension: one row per airport."""
    names = airports.select("airport").where("airport is not null").distinct()
    return names.select("airport", (F.row_number().over(Window.orderBy("airport")) - 1).alias("node_idx"))


def with_endpoints(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Node numbers of both ends; edges with an unknown end are dropped."""
    src = index.select(F.col("airport").alias("src_airport"), F.col("node_idx").alias("src_idx"))
    dst = index.select(F.col("airport").alias("dst_airport"), F.col("node_idx").alias("dst_idx"))
    return edges.join(src, "src_airport").join(dst, "dst_airport")

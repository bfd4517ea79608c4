"""Station weather: parsed CSV files and raw fixed-width hourly records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.conform import DAY_FIRST_FORMATS, clean_header, conform, parse_timestamp
from skyledger.functions.expr import relative_humidity
from skyledger.functions.sequence import along_key
from skyledger.sources.flights import headers
from skyledger.sources.schemas import WEATHER, WEATHER_ALIASES

# Fixed value: AIRPORT_YEAR file names, with the common misspelt extension.
FILE_NAME = r"(?i)(?:^|/)([A-Z]{3,4})_(\d{4})\.(csv|csc)$"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, airport, year) of every CSV-like file; airport is null when misnamed."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{csv,csc,CSV,CSC}").load(folder).select("path", "length")
    )
    ap = F.upper(F.regexp_extract("path", FILE_NAME, 1))
    year = F.regexp_extract("path", FILE_NAME, 2)
    return files.select(
        "path", "length",
        F.when(ap != "", ap).alias("airport"),
        F.when(year != "", year.cast("int")).alias("file_year"),
    )


def read_weather(spark: SparkSession, folder: str) -> DataFrame:
    """All AIRPORT_YEAR files of a folder under one schema.

    Files that share a header are read as one scan, so the plan has one branch per
    distinct header rather than one per file. The driver sees file names and header
    lines only.
    """
    named = list_files(spark, folder).where("airport is not null").select("path").orderBy("path")
    paths = [row.path for row in named.toLocalIterator()]
    if not paths:
        raise FileNotFoundError(f"no weather files in {folder}")
    parts = [_one_header(spark, own) for own in headers(spark, paths).values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _one_header(spark: SparkSession, paths: list[str]) -> DataFrame:
    raw = spark.read.csv(paths, header=True, inferSchema=False).withColumn("source_path", F.input_file_name())
    raw = clean_header(raw, lower=True)
    when = next((c for c in raw.columns if "datetime" in c), None)
    if when is None:
        return spark.createDataFrame([], T.StructType(WEATHER.fields + [
            T.StructField("airport", T.StringType()), T.StructField("file_year", T.IntegerType())]))
    raw = raw.withColumn("datetime", parse_timestamp(when, DAY_FIRST_FORMATS))
    out = conform(raw.where("datetime is not null"), WEATHER, WEATHER_ALIASES, keep_extra=True)
    return out.select(
        *WEATHER.names,
        F.upper(F.regexp_extract("source_path", FILE_NAME, 1)).alias("airport"),
        F.regexp_extract("source_path", FILE_NAME, 2).cast("int").alias("file_year"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw record lines, gzip or plain, decoded; the airport comes from the file name."""
    lines = spark.read.text(path).withColumn("source_path", F.input_file_name())
    # One gzip file is one task whatever its size, so spread the lines before decoding.
    lines = lines.repartition(spark.sparkContext.defaultParallelism)
    airport = F.upper(F.regexp_extract("source_path", r"(?i)(?:^|/)([A-Z]{3,4})_(\d{4})\.", 1))
    return decode_records(lines.withColumn("airport", F.when(airport != "", airport)), "value")


# Mandatory section, name -> (first character counted from 1, length, sentinel, divisor).
MANDATORY = {
    "latitude": (29, 6, 99999, 1000),
    "longitude": (35, 7, 999999, 1000),
    "elevation_m": (47, 5, 9999, 1),
    "wind_dir_deg": (61, 3, 999, 1),
    "wind_speed_ms": (66, 4, 9999, 10),
    "ceiling_m": (71, 5, 99999, 1),
    "visibility_m": (79, 6, 999999, 1),
    "temp_c": (88, 5, 9999, 10),
    "dewpoint_c": (94, 5, 9999, 10),
    "sea_level_pressure_hpa": (100, 5, 99999, 10),
}
# Optional sections, name -> (tag, shortest section, first character counted from 1,
# length, sentinel, divisor).
OPTIONAL = {
    "precip_depth_mm": ("AA1", 8, 4, 4, 9999, 10),
    "snow_depth_mm": ("AJ1", 7, 4, 4, 9999, 1),
    "sky_cover_oktas": ("GF1", 5, 4, 2, 99, 1),
    "altimeter_hpa": ("MA1", 13, 2, 5, 99999, 10),
    "station_pressure_hpa": ("MA1", 13, 8, 5, 99999, 10),
    "pressure_tendency_hpa": ("MD1", 8, 3, 5, 99999, 10),
    "wind_gust_ms": ("OC1", 7, 4, 4, 9999, 10),
    "extreme_temp_c": ("KA1", 9, 5, 5, 9999, 10),
}


def _number(text: Column) -> Column:
    return F.trim(text).try_cast("int")


def _measure(raw: Column, sentinel: int, divisor: int) -> Column:
    return F.when(raw != sentinel, raw / F.lit(float(divisor)))


STAMP = {"year": (16, 4), "month": (20, 2), "day": (22, 2), "hour": (24, 2), "minute": (26, 2)}


def undecodable(line: Column) -> Column:
    """Why `decode_records` drops a line; null for lines that it keeps."""
    unread = lambda parts: reduce(lambda a, b: a | b, [_number(F.substring(line, p, k)).isNull() for p, k in parts])
    return F.when(F.coalesce(F.length(line), F.lit(0)) < 60, F.lit("record too short")).when(unread(STAMP.values()), F.lit("time not readable")).when(
        unread([v[:2] for v in MANDATORY.values()]), F.lit("number not readable"))


def decode_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """Fixed-width hourly records to columns.

    A line shorter than 60 characters, or with an unreadable mandatory number, is
    dropped; sentinels become null; an unreadable optional section is null.
    """
    line = F.col(value)
    numbers = {n: _number(F.substring(line, p, k)) for n, (p, k) in STAMP.items()}
    numbers |= {f"__{n}": _number(F.substring(line, p, k)) for n, (p, k, _, _) in MANDATORY.items()}
    kept = [c for c in lines.columns if c != value]
    out = lines.where(F.length(line) >= 60).withColumns(numbers).dropna(subset=list(numbers))
    out = out.withColumn("__extra", F.trim(F.substr(line, F.lit(106), F.length(line))))

    columns = {n: _measure(F.col(f"__{n}"), s, d) for n, (_, _, s, d) in MANDATORY.items()}
    for name, (tag, shortest, first, size, sentinel, divisor) in OPTIONAL.items():
        at = F.instr(F.col("__extra"), tag)
        section = F.when(at > 0, F.substring(F.col("__extra"), at, F.length("__extra")))
        number = F.when(F.length(section) >= shortest, _number(F.substring(section, first, size)))
        columns[name] = _measure(number, sentinel, divisor)
    # The period is looked for where the section repeats its own tag, so it is never known.
    columns["precip_period_h"] = F.lit(None).cast("int")
    out = out.withColumns(columns).withColumns({
        "datetime": F.try_make_timestamp_ntz("year", "month", "day", "hour", "minute", F.lit(0)),
        "relative_humidity_pct": relative_humidity("temp_c", "dewpoint_c"),
        "station_id": F.trim(F.substring(line, 5, 6)),
        "wban": F.trim(F.substring(line, 11, 5)),
    })
    fields = [
        "datetime", "year", "month", "day", "hour", "minute", "latitude", "longitude", "elevation_m",
        "temp_c", "dewpoint_c", "relative_humidity_pct", "wind_dir_deg", "wind_speed_ms",
        "wind_gust_ms", "sea_level_pressure_hpa", "altimeter_hpa", "station_pressure_hpa",
        "pressure_tendency_hpa", "visibility_m", "ceiling_m", "sky_cover_oktas", "precip_depth_mm",
        "precip_period_h", "snow_depth_mm", "extreme_temp_c", "station_id", "wban",
    ]
    return out.select(*kept, *fields)


def station_candidates(history: DataFrame, order: str) -> DataFrame:
    """Candidate WBAN ids per USAF id: 99999 first, then in listing order (`order`).

    One row per candidate with its rank, so a USAF id with many stations is no
    single large array.
    """
    listed = history.select(
        F.trim("USAF").alias("usaf"), F.trim("WBAN").alias("wban"), F.col(order).alias("__at")
    ).where("usaf is not null and wban is not null")
    default = listed.select("usaf", F.lit("99999").alias("wban")).distinct().withColumn("__at", F.lit(None).cast("long"))
    every = default.unionByName(listed.where("wban <> '99999'").withColumn("__at", F.col("__at").cast("long")))
    ranked = along_key(
        every.withColumn("__at", F.coalesce("__at", F.lit(-1))), ["usaf"], ["__at"], F.floor(F.col("__at") / 100000), position="rank")
    return ranked.select("usaf", "rank", "wban")

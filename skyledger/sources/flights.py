"""Flight files: yearly and monthly on-time CSVs, and previously written tables."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skyledger.functions.conform import DAY_FIRST_FORMATS, clean_header, conform, parse_timestamp
from skyledger.sources.schemas import PREDICTIONS


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence through the Hadoop file system of the path (globs allowed)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def existing(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    return [p for p in paths if path_exists(spark, p)]


def _files(spark: SparkSession, path: str) -> list:
    """Hadoop paths of the data files a path, glob or folder names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    found = []
    for status in fs.globStatus(where) or []:
        inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [s.getPath() for s in inner if s.isFile() and s.getLen() and s.getPath().getName()[:1] not in "._"]
    return found


def _first_line(spark: SparkSession, file) -> str | None:
    """Opens the file and reads its first block only; compressed files through their codec."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stream = file.getFileSystem(conf).open(file)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
        inside = codec.createInputStream(stream) if codec is not None else stream
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(inside, "UTF-8")).readLine()
    finally:
        stream.close()


def headers(spark: SparkSession, paths: Iterable[str]) -> dict[str, list[str]]:
    """First line of every text file and the files that begin with it.

    Only the beginning of each file is opened, several at a time; no job runs and nothing else is read, however long the files are.
    """
    files = sorted((f for p in paths for f in _files(spark, p)), key=str)
    found: dict[str, list[str]] = {}
    with ThreadPoolExecutor(16) as pool:
        for file, line in zip(files, pool.map(lambda f: _first_line(spark, f), files)):
            if line is not None:
                found.setdefault(line, []).append(str(file))
    return found


def read_csv_files(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """All given CSV files that exist, as strings under their own headers.

    Files are matched to each other by column name, so yearly files whose columns
    differ or come in another order can be read together; absent files are skipped.
    """
    found = existing(spark, paths)
    if not found:
        raise FileNotFoundError("none of the flight files exists")
    # Files that share a header are one scan.
    frames = [clean_header(spark.read.csv(own, header=True, inferSchema=False)) for own in headers(spark, found).values()]
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def read_flights(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A flights table by format; text dates are parsed day first, unparsable ones are null."""
    fmt = fmt or ("csv" if path.rstrip("/").lower().endswith((".csv", ".csv.gz")) else "parquet")
    if fmt == "csv":
        df = clean_header(spark.read.csv(path, header=True, inferSchema=False))
    else:
        df = spark.read.format(fmt).load(path)
    for c in ("dep_datetime", "arr_datetime", "weather_time", "FlightDate"):
        if c in df.columns and isinstance(df.schema[c].dataType, T.StringType):
            df = df.withColumn(c, parse_timestamp(c, DAY_FIRST_FORMATS))
    if "FlightDate" in df.columns:
        df = df.withColumn("FlightDate", df["FlightDate"].cast("date"))
    return df


def first_available(spark: SparkSession, paths: Iterable[str]) -> str:
    """The first existing path: the enriched table before the raw one."""
    for path in paths:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError("no flights table at any of the given paths")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet table, or no rows of the given schema when it was never written."""
    if path_exists(spark, path):
        return spark.read.parquet(path)
    return spark.createDataFrame([], schema)


def read_predictions(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A prediction log from CSV or parquet; filters on it reach the scan."""
    fmt = fmt or ("csv" if path.rstrip("/").lower().endswith((".csv", ".csv.gz")) else "parquet")
    if fmt == "csv":
        return conform(spark.read.csv(path, header=True, inferSchema=False), PREDICTIONS, keep_extra=True)
    return spark.read.format(fmt).load(path)

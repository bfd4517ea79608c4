"""Tables laid out for the joins and windows that read them: clustered by key, or in folders by day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAIL_KEYS = ["Tail_Number", "dep_day"]


def cluster(df: DataFrame, table: str, path: str, keys: Sequence[str], sort: Sequence[str], buckets: int) -> DataFrame:
    """Write a catalog table at `path` in `buckets` parts by `keys`, each sorted, and read it back.

    Rows are dealt to their part before the write, so every part is one file. Windows, aggregations and joins on all of `keys` read the
    parts as they are. Choose `buckets` so that a part fits a task: by a few hundred MB of the table.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys, *sort).saveAsTable(table)
    return df.sparkSession.table(table)


def reopen(spark: SparkSession, table: str, path: str, keys: Sequence[str], sort: Sequence[str], buckets: int) -> DataFrame:
    """A clustered table that another session wrote, entered into this session's catalog with its layout."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    quoted = lambda names: ", ".join(f"`{n}`" for n in names)
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({quoted(keys)}) SORTED BY ({quoted([*keys, *sort])}) "
              f"INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(table)


def flights_by_tail(flights: DataFrame, table: str, path: str, *, buckets: int) -> DataFrame:
    """Flights clustered by (tail, day): a day of one aircraft lies together, a tail with very many flights is spread over its days."""
    return cluster(flights.withColumn("dep_day", F.to_date("dep_datetime")), table, path, TAIL_KEYS, ["dep_datetime", "flight_id"], buckets)


def write_by_day(df: DataFrame, path: str, *, time: str = "dep_datetime", day: str = "dep_day") -> None:
    """One folder per day; a day with very many rows is spread over several files."""
    dated = df.withColumn(day, F.to_date(time))
    dated.repartitionByRange(day, time).write.mode("overwrite").partitionBy(day).parquet(path)


def on_days(by_day: DataFrame, days: DataFrame, *, day: str = "dep_day") -> DataFrame:
    """Rows of the days in `days` (one column, `day`): while it runs, Spark reads those days' folders only.

    `days` should carry its own filter (a wanted range, a rank); its list prunes the scan of the other side.
    """
    return by_day.join(days.select(day), day, "left_semi")

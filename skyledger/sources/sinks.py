"""Writers. Tables are parquet, partitioned where readers select by day or year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.conform import conform
from skyledger.sources.schemas import MODEL_COMPARISON


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_flights(df: DataFrame, path: str) -> None:
    """Flights in departure order, one folder per year."""
    ordered = df.repartitionByRange("Year", "dep_datetime").sortWithinPartitions("Year", "dep_datetime")
    ordered.write.mode("overwrite").partitionBy("Year").parquet(path)


def write_snapshots(df: DataFrame, path: str) -> None:
    """Snapshot-keyed tables, one folder per day; a hot day is spread over several files."""
    dated = df.withColumn("snapshot_date", F.to_date("snapshot_time"))
    dated.repartitionByRange("snapshot_date", "snapshot_time", *_id(df)).write.mode("overwrite").partitionBy(
        "snapshot_date").parquet(path)


def _id(df: DataFrame) -> list[str]:
    return [c for c in ("flight_id", "airport", "src_airport", "dst_airport") if c in df.columns]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_comparison(row: DataFrame, path: str) -> None:
    """Add a run's metrics to the comparison table; older rows keep missing metrics as null."""
    conform(row, MODEL_COMPARISON).write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)

"""Tables that streaming queries write batch by batch: one folder a batch, folded into snapshots.

A batch owns the folder of its number and replaces it when it is repeated after a failure, so every row counts
once. Update-mode results hold a key once for each batch that changed it; every so many batches they are folded into a
snapshot with each key's newest row, and a reader takes the newest finished snapshot and the batches after it. Batches
are removed one snapshot later than they are folded, so a reader that began with the snapshot before still finds its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLD_EVERY = 48  # a day of half-hour cycles
SNAPSHOTS = "_snapshots"  # names that begin with an underscore are no part of the table to Spark's readers


def _numbers(spark: SparkSession, path: str, name: str, *, finished: bool = False) -> list[int]:
    """Numbers of the folders `<name>=<n>` under a path, in rising order; `finished` asks for a completed write."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [str(s.getPath()) for s in fs.listStatus(folder)]
    marked = [p for p in found if f"/{name}=" in p]
    if finished:
        marked = [p for p in marked if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))]
    return sorted(int(p.rpartition("=")[2]) for p in marked)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def batch_writer(path: str, keys: list[str] | None = None, *, fold_every: int = FOLD_EVERY) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`. With `keys` the table is folded every `fold_every` batches; without, batches are only added."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if keys and (number + 1) % fold_every == 0:
            fold(batch.sparkSession, path, keys, number)
    return write


def fold(spark: SparkSession, path: str, keys: list[str], upto: int) -> None:
    """Write the snapshot of all batches up to a number, then drop the batches that the snapshot before it held."""
    snapshots = f"{path}/{SNAPSHOTS}"
    before = [n for n in _numbers(spark, snapshots, "upto", finished=True) if n < upto]
    _newest(spark, path, keys, before[-1] if before else None, upto).write.mode("overwrite").parquet(f"{snapshots}/upto={upto}")
    for number in _numbers(spark, path, "batch") if before else []:
        if number <= before[-1]:
            _remove(spark, f"{path}/batch={number}")
    for number in before[:-1]:
        _remove(spark, f"{snapshots}/upto={number}")


def _newest(spark: SparkSession, path: str, keys: list[str], snapshot: int | None, upto: int | None = None) -> DataFrame:
    """Each key's row of the latest batch that has one, from a snapshot and the batches after it."""
    tail = [n for n in _numbers(spark, path, "batch") if (snapshot is None or n > snapshot) and (upto is None or n <= upto)]
    parts = []
    if snapshot is not None:
        parts.append(spark.read.parquet(f"{path}/{SNAPSHOTS}/upto={snapshot}"))
    if tail:
        parts.append(spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in tail]))
    if not parts:
        raise FileNotFoundError(f"no batch has been written to {path}")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(*keys, "r.*")


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The table of an update-mode query as of its last batch: what it reads is one snapshot and at most a cycle of batches."""
    snapshots = _numbers(spark, f"{path}/{SNAPSHOTS}", "upto", finished=True)
    return _newest(spark, path, keys, snapshots[-1] if snapshots else None).drop("batch")

"""Session factory, and tables written to the shared folder to cut lineage."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_scopes: list[list[str]] = []


def session(app: str = "skyledger", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Split skewed sides even where that costs one more exchange afterwards.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # Streaming state on disk rather than in executor memory.
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session without one gets a folder of its own, a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="skyledger-")
    return _local_roots[app]


def new_folder(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end; results must have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def scoped(job: Callable) -> Callable:
    """Run a job (spark, ...) that writes its results inside a scope of its own."""
    @functools.wraps(job)
    def run(spark: SparkSession, *args, **kwargs):
        with scope(spark):
            return job(spark, *args, **kwargs)
    return run


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write once, read back.

    The table survives the loss of executors, is computed once however often it is
    used, and has a known size, so Spark itself decides from that size whether a
    join with it may be broadcast (spark.sql.autoBroadcastJoinThreshold).
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Rows and payloads that do not parse, kept with where they stood and why, instead of vanishing.

Rejects have one schema whatever their source: file, row (its text), reason, dropped (whether the row is missing from the table, or
only a value of it became null).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.sources.weather import undecodable

BAD = "_corrupt"
COLUMNS = ["file", "row", "reason", "dropped"]


def read_csv(spark: SparkSession, paths: str | list[str], header: Sequence[str], checks: Mapping[str, Column] = {}, required: Sequence[str] = (),
             *, has_header: bool = True) -> DataFrame:
    """CSV rows as text under `header`, with `file`, `reasons` (array) and `keep`.

    A row with more or fewer values than the header is not kept. `checks` names a condition per column that a value which is there must
    meet, such as `F.col("DepDelay").try_cast("double").isNotNull()`; a failed one is a reason, and for `required` columns, which must
    also be there, costs the row.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, BAD]])
    rows = spark.read.schema(schema).option("header", has_header).option("enforceSchema", True).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", BAD).csv(paths).withColumn("file", F.col("_metadata.file_path"))
    whole = F.col(BAD).isNull()
    reasons = [F.when(~whole, F.lit("number of values"))]
    for name in {**dict.fromkeys(checks), **dict.fromkeys(required)}:
        there = F.col(f"`{name}`").isNotNull()
        if name in checks:
            reasons.append(F.when(whole & there & ~F.coalesce(checks[name], F.lit(False)), F.lit(f"{name}: not readable")))
        if name in required:
            reasons.append(F.when(whole & ~there, F.lit(f"{name}: missing")))
    lost = [f"{n}: {why}" for n in required for why in ("not readable", "missing")]
    found = F.array_compact(F.array(*reasons))
    return rows.withColumn("reasons", found).withColumn("keep", whole & ~F.arrays_overlap("reasons", F.array(*[F.lit(r) for r in lost]) if lost else F.array().cast("array<string>")))


def kept(rows: DataFrame) -> DataFrame:
    """The rows of `read_csv` that stay, without its own columns."""
    return rows.where("keep").drop(BAD, "file", "reasons", "keep")


def of_rows(rows: DataFrame) -> DataFrame:
    """One reject per reason of the rows of `read_csv`."""
    values = [c for c in rows.columns if c not in (BAD, "file", "reasons", "keep")]
    text = F.coalesce(F.col(BAD), F.array_join(F.array(*[F.col(f"`{c}`") for c in values]), ",", ""))
    return rows.where(F.size("reasons") > 0).select("file", text.alias("row"), F.explode("reasons").alias("reason"), (~F.col("keep")).alias("dropped"))


def of_lines(lines: DataFrame, *, text: str = "value", file: str = "file") -> DataFrame:
    """Fixed-width record lines that cannot be decoded: exactly those that `weather.decode_records` leaves out."""
    return lines.withColumn("__r", undecodable(F.col(text))).where("__r is not null").select(
        F.col(file).alias("file"), F.col(text).alias("row"), F.col("__r").alias("reason"), F.lit(True).alias("dropped"))


def of_payloads(feed: DataFrame, schema: T.StructType, *, payload: str = "payload", source: str | None = None) -> DataFrame:
    """Feed payloads that are no JSON of the feed's shape. Markup payloads (they begin with `<`) are not judged here."""
    shape = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    parsed = F.from_json(F.col(payload), shape, {"columnNameOfCorruptRecord": BAD, "mode": "PERMISSIVE"})
    empty = F.coalesce(F.trim(payload), F.lit("")) == ""
    reason = F.when(empty, F.lit("empty")).when(F.ltrim(payload).startswith("<"), F.lit(None)).when(parsed[BAD].isNotNull(), F.lit("not the feed's JSON"))
    return feed.withColumn("__r", reason).where("__r is not null").select(
        (F.col(source).cast("string") if source else F.lit(None).cast("string")).alias("file"), F.col(payload).alias("row"), F.col("__r").alias("reason"),
        F.lit(True).alias("dropped"))


def report(rejects: DataFrame) -> DataFrame:
    """Rejects by reason, to be written beside the table."""
    return rejects.groupBy("reason", "dropped").agg(F.count(F.lit(1)).alias("rows"))


def write(rejects: DataFrame, path: str) -> None:
    """One folder per reason."""
    rejects.write.mode("overwrite").partitionBy("reason").parquet(path)

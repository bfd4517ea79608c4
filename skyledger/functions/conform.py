"""Bring an input with a loose header to a fixed schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_header(df: DataFrame, *, lower: bool = False) -> DataFrame:
    """Strip column names, drop unnamed trailing columns; optionally lower-case with underscores."""
    named = [
        (c, c.strip()) for c in df.columns
        if c.strip() and not c.strip().startswith("Unnamed") and not c.strip().startswith("_c")
    ]
    if lower:
        named = [(c, n.lower().replace(" ", "_")) for c, n in named]
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in named])


def conform(
    df: DataFrame, schema: T.StructType, aliases: Mapping[str, Sequence[str]] | None = None,
    *, keep_extra: bool = False,
) -> DataFrame:
    """Select `schema` from `df`: first alias present wins, a missing column is a typed null,
    a value that does not parse is null."""
    aliases = aliases or {}
    taken, out = set(), []
    for field in schema.fields:
        source = next((c for c in aliases.get(field.name, [field.name]) if c in df.columns), None)
        if source is None:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        taken.add(source)
        same = df.schema[source].dataType == field.dataType
        c = F.col(f"`{source}`")
        out.append((c if same else c.try_cast(field.dataType)).alias(field.name))
    if keep_extra:
        out += [F.col(f"`{c}`") for c in df.columns if c not in taken and c not in schema.names]
    return df.select(*out)


def parse_timestamp(c: str, formats: Sequence[str]):
    """First format that parses, as timestamp_ntz; otherwise null."""
    text = F.trim(F.col(c).cast("string"))
    tries = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries)


# Text layouts accepted for dates and times; day first where ambiguous.
ISO_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd"]
DAY_FIRST_FORMATS = ISO_FORMATS + ["d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy", "d-M-yyyy H:mm", "d-M-yyyy"]

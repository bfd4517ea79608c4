"""Words, and DataFrame-to-Arrow helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII blanks; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = b" \t\n\r\x0b\x0c"


def words(raw: bytes | None) -> list[bytes]:
    return raw.split() if raw else []


def pick(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, whatever else the table holds; a null text is empty."""
    return df.select(df[id_col].alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def raw(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def rows(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Row tuples of the named columns; strings come as UTF-8 bytes."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        yield from zip(*[raw(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_pylist() for c in columns])


def batched(found: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most `size` rows from row tuples."""
    held: list[tuple] = []
    for row in found:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def map_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], names: list[str], kinds: str,
             arrow: pa.Schema, size: int = 4096) -> DataFrame:
    """`fn` over the row tuples of a partition, as they stream by; nothing is gathered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(fn(rows(batches, *names)), arrow, size)
    return df.mapInArrow(run, kinds)


def id_type(df: DataFrame) -> tuple[str, pa.DataType]:
    """Spark's and Arrow's name of the `id` column's type."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema["id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def crc_remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))

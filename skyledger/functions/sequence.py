"""Neighbour rows and running totals along an ordered key.

A plain window puts every row of one key into one task. Here every key is cut into slots of time:
the window runs inside each (key, slot), one summary row per slot carries the edge rows and totals,
and a second window over those summaries links the slots. The result is the same as the plain
window for every row, and the plan is the same whatever the size of a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slot: Column,
    *,
    following: Sequence[str] = (),
    preceding: Sequence[str] = (),
    totals: Mapping[str, Column] | None = None,
    position: str | None = None,
) -> DataFrame:
    """Add `next_<c>` / `prev_<c>` structs' fields, totals over earlier rows and 0-based position.

    `order` must be a unique ordering within the key, and `slot` must rise with it, with a grain (an hour,
    a day) that leaves few rows of a key in a slot and few slots in a key. Keys and slot must not be null. Added columns: `next_row` (struct of
    `following`, null on the last row), `prev_row` (struct of `preceding`, null on the first row), one
    column per entry of `totals` (sum over strictly earlier rows, 0 when none) and `position`.
    Raw rows are exchanged once, by key and slot; what is joined to them is one row per key and slot.
    """
    totals = dict(totals or {})
    keys, order = list(keys), list(order)

    rows = df.withColumn("__slot", slot)
    for name, expr in totals.items():
        rows = rows.withColumn(f"__add_{name}", F.coalesce(expr.cast("double"), F.lit(0.0)))

    w = Window.partitionBy(*keys, "__slot").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    inside = rows
    if following:
        inside = inside.withColumn("__next", F.lead(F.struct(*following)).over(w))
    if preceding:
        inside = inside.withColumn("__prev", F.lag(F.struct(*preceding)).over(w))
    for name in totals:
        inside = inside.withColumn(f"__sum_{name}", F.sum(f"__add_{name}").over(before))
    if position:
        inside = inside.withColumn("__pos", F.row_number().over(w) - 1)

    # Per-slot summaries: partial aggregation, no full group anywhere.
    aggs = [F.count(F.lit(1)).alias("__rows")]
    if following:
        aggs.append(F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                                   F.struct(*following).alias("row"))).alias("__first"))
    if preceding:
        aggs.append(F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                                   F.struct(*preceding).alias("row"))).alias("__last"))
    aggs += [F.sum(f"__add_{name}").alias(f"__add_{name}") for name in totals]
    slots = rows.groupBy(*keys, "__slot").agg(*aggs)
    ws = Window.partitionBy(*keys).orderBy("__slot")
    ws_before = ws.rowsBetween(Window.unboundedPreceding, -1)
    link = [*keys, "__slot"]
    if following:
        link.append(F.lead("__first.row").over(ws).alias("__next_slot"))
    if preceding:
        link.append(F.lag("__last.row").over(ws).alias("__prev_slot"))
    link += [F.sum(f"__add_{n}").over(ws_before).alias(f"__base_{n}") for n in totals]
    if position:
        link.append(F.sum("__rows").over(ws_before).alias("__pos_base"))
    joined = inside.join(slots.select(*link), [*keys, "__slot"], "left")

    out = [F.col(c) for c in df.columns]
    if following:
        out.append(F.coalesce("__next", "__next_slot").alias("next_row"))
    if preceding:
        out.append(F.coalesce("__prev", "__prev_slot").alias("prev_row"))
    zero = F.lit(0.0)
    out += [
        (F.coalesce(f"__sum_{n}", zero) + F.coalesce(f"__base_{n}", zero)).alias(n) for n in totals
    ]
    if position:
        out.append((F.col("__pos") + F.coalesce("__pos_base", F.lit(0))).cast("long").alias(position))
    return joined.select(*out)


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]
) -> DataFrame:
    """Exact interpolated percentiles per key.

    Equal values are counted first (with map-side combine), so the final buffer of
    a group holds its distinct values only: delays, gaps and taxi times are whole
    minutes, a few thousand values however many rows there are.
    """
    names = list(points)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    found = counted.groupBy(*keys).agg(
        F.percentile(value, F.array(*[F.lit(float(points[n])) for n in names]), F.col("__n")).alias("__p")
    )
    return found.select(*keys, *[F.try_element_at("__p", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row, as one scalar subquery."""
    value = row.select(F.struct(*row.columns).alias("r")).scalar()
    return df.withColumn("__row", value).select(*df.columns, *[F.col(f"__row.{c}").alias(c) for c in row.columns])

"""Joins along time: the nearest row of another table, rows inside intervals, and intervals that overlap.

All of them are equality joins, windows or running totals on slots of time with exact rules inside, so no pair is formed that lies further
apart than a slot, and a key with very many rows is spread over its slots. Timestamps count by their fields, to the microsecond.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000


def micros(time: Column | str) -> Column:
    c = F.col(time) if isinstance(time, str) else time
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def nearest_row(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], *,
    direction: str = "nearest", within_s: float | None = None, strict: bool = False, slot_s: int = 6 * 3600, name: str = "match",
) -> DataFrame:
    """`left` with a struct of the right row next to it in time: `right_time` and `columns`, or null.

    `backward` takes the last right row at or before the left one, `forward` the first at or after it, `nearest` the
    closer of the two, on a tie the earlier. Of right rows with one key and time the one with the smallest `columns` counts. Rows
    further away than `within_s` are no match, with `strict` neither those exactly so far. Left rows with a null
    key or time match nothing and stay.

    Both tables go side by side into slots of `slot_s` seconds and are exchanged once, by key and slot; the nearest row inside a slot is a
    window over it, the one beyond comes from a summary of one row per key and slot. `keys` may be empty.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {direction}")
    keys = list(keys)
    slot = F.floor(F.col("__t") / (slot_s * SECOND))
    whole = F.lit(True)
    for c in (*keys, left_time):
        whole = whole & F.col(f"`{c}`").isNotNull()
    row = F.struct(F.col("__t").alias("t"), F.struct(right_time, *columns).alias("row"))
    rows = left.where(whole).select(*[F.col(f"`{k}`").alias(f"__k_{k}") for k in keys], micros(F.col(f"`{left_time}`")).alias("__t"),
                                    F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__left"))
    there = right.dropna(subset=[*keys, right_time]).groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys], right_time).agg(
        F.min(F.struct(*columns) if columns else F.struct(F.lit(0).alias("__none"))).alias("__c"))
    there = there.select(*[f"__k_{k}" for k in keys], right_time, *[F.col("__c").getField(c).alias(c) for c in columns])
    there = there.select(*[f"__k_{k}" for k in keys], micros(right_time).alias("__t"), right_time, *columns)
    there = there.select(*[f"__k_{k}" for k in keys], "__t", row.alias("__right"))
    key = [f"__k_{k}" for k in keys]

    both = rows.unionByName(there, allowMissingColumns=True).withColumn("__slot", slot)
    # Both frames grow with the row: one that ends at the last row would be worked out anew for every row. Read backwards, the rows after
    # a left row come first, and right rows of the same time, which stand before left ones, come last.
    place = (F.col("__t"), F.col("__left").isNotNull())
    w = Window.partitionBy(*key, "__slot").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*key, "__slot").orderBy(*[c.desc() for c in place]).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.select(
        *key, "__slot", "__t", "__left", F.last("__right", ignorenulls=True).over(w).alias("__before"),
        F.last("__right", ignorenulls=True).over(back).alias("__after")).where(F.col("__left").isNotNull())

    none = F.lit(None).cast(there.schema["__right"].dataType)
    known = there.withColumn("__slot", slot).groupBy(*key, "__slot").agg(
        F.min_by("__right", "__t").alias("__first"), F.max_by("__right", "__t").alias("__last"))
    asked = rows.select(*key, slot.alias("__slot")).distinct().select(*key, "__slot", none.alias("__first"), none.alias("__last"))
    slots = known.unionByName(asked).groupBy(*key, "__slot").agg(F.first("__first", ignorenulls=True).alias("__first"),
                                                                 F.first("__last", ignorenulls=True).alias("__last"))
    ws = Window.partitionBy(*key)  # one row per key and slot
    up, down = [ws.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("__slot", F.desc("__slot"))]
    slots = slots.select(*key, "__slot", F.last("__last", ignorenulls=True).over(up).alias("__before_slot"),
                         F.last("__first", ignorenulls=True).over(down).alias("__after_slot"))

    found = inside.join(slots, [*key, "__slot"], "left")
    before, after = F.coalesce("__before", "__before_slot"), F.coalesce("__after", "__after_slot")
    to_before, to_after = F.col("__t") - before["t"], after["t"] - F.col("__t")
    # A right row of the very same time is the row before; forward takes it, too.
    best = {
        "backward": before,
        "forward": F.when(to_before == 0, before).otherwise(after),
        "nearest": F.when(after.isNull() | (to_before <= to_after), before).otherwise(after),
    }[direction]
    found = found.withColumn("__best", best)
    if within_s is not None:
        away, most = F.abs(F.col("__t") - F.col("__best.t")), int(within_s * SECOND)
        found = found.withColumn("__best", F.when((away < most) if strict else (away <= most), F.col("__best")))
    out = found.select("__left.*", F.col("__best.row").alias(name))
    without = left.where(~whole).select(*[F.col(f"`{c}`") for c in left.columns], F.lit(None).cast(out.schema[name].dataType).alias(name))
    return out.unionByName(without)


def points_in(points: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str, start: str, end: str, *, base_s: int = 3600,
              after_start: bool = False) -> DataFrame:
    """Pairs of a point and an interval [start, end) of the same key that holds it (with `after_start`, (start, end)).

    Lengths may differ by any factor: an interval belongs to the level of the next power of two of `base_s` above its length, where it
    touches five slots, quarters of that power, at most; a point asks each level that occurs, a few dozen at most, in the one slot it lies in.
    Empty intervals and null times match nothing. Columns other than `keys` must have names of their own.

    The pairs are the work, and bytes do not tell how many there are: both sides are dealt to a fixed number of tasks, which adaptive
    execution neither merges nor replaces by a broadcast.
    """
    keys = list(keys)
    base = base_s * SECOND
    a, b = F.col("__a"), F.col("__b")
    spans = intervals.withColumns({"__a": micros(start), "__b": micros(end)}).where(b > a)
    level = F.greatest(F.ceil(F.log2((b - a) / F.lit(float(base)))), F.lit(0)).cast("int")
    spans = spans.withColumn("__level", level)
    width = F.greatest((F.lit(base / 4) * F.pow(F.lit(2.0), F.col("__level"))).cast("long"), F.lit(1))
    levels = spans.agg(F.collect_set("__level")).scalar()
    spans = spans.withColumn("__slot", F.explode(F.sequence(F.floor(a / width), F.floor((b - 1) / width))))
    asking = points.withColumn("__t", micros(time)).where(F.col("__t").isNotNull())
    asking = asking.withColumn("__level", F.explode(levels)).withColumn("__slot", F.floor(F.col("__t") / width))
    t = F.col("__t")
    by, parts = [*keys, "__level", "__slot"], 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = asking.repartition(parts, *by).hint("merge").join(spans.repartition(parts, *by), by).where((t > a if after_start else t >= a) & (t < b))
    return met.drop("__level", "__slot", "__t", "__a", "__b")


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str], a_span: tuple[str, str], b_span: tuple[str, str], *, base_s: int = 3600,
                totals: str | None = None) -> DataFrame:
    """Pairs of intervals [start, end) of the same key that share some time, each pair once.

    Two intervals overlap when one begins inside the other: b at or after a's start, or a after b's. The two cases exclude each
    other, so nothing has to be made distinct. Empty intervals overlap nothing.

    With `totals`, a column of b, every a that overlaps any b comes once instead, with `n`, the number of those b, and `least`, their two
    smallest distinct values of that column (one where there is one; nulls do not count). No pair is formed, so this grows with the rows.
    """
    if totals is not None:
        return _overlap_totals(a, b, list(keys), a_span, b_span, totals)
    whole = lambda df, span: df.where(micros(span[1]) > micros(span[0]))
    first = points_in(whole(b, b_span), a, keys, b_span[0], *a_span, base_s=base_s)
    second = points_in(whole(a, a_span), b, keys, a_span[0], *b_span, base_s=base_s, after_start=True)
    return first.unionByName(second)


def _width() -> Column:
    return F.pow(F.lit(2.0), F.col("__level")).cast("long")


def _slot_of(t: Column | str) -> Column:
    """Where the slot of the row's level begins that holds `t`."""
    c = F.col(t) if isinstance(t, str) else t
    return c - F.pmod(c, _width())


def _least(*values: Column) -> Column:
    return F.slice(F.array_sort(F.array_distinct(F.array_compact(F.concat(*values)))), 1, 2)


def _with_slots(df: DataFrame, keys: list[str], span: tuple[str, str]) -> DataFrame:
    """Non-empty intervals with their ends in half microseconds and the level whose slots are shorter than the interval, and at least half as long."""
    found = df.dropna(subset=keys).withColumns({"__s": 2 * micros(span[0]), "__e": 2 * micros(span[1])}).where("__e > __s")
    found = found.withColumn("__level", F.length(F.bin(F.col("__e") - F.col("__s") - 1)) - 1)
    return found.withColumns({"__p": _slot_of("__s"), "__r": _slot_of("__e")})


def _entries(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of each group one row with its sum of `__n` and at most two with its least values of `__id`."""
    none = F.lit(None).cast(rows.schema["__id"].dataType)
    counts = rows.groupBy(*by).agg(F.sum("__n").alias("__n")).select(*by, "__n", none.alias("__id"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("__id"))
    least = rows.where("__id is not null").select(*by, "__id").distinct().withColumn("__place", place).where("__place <= 2")
    return counts.unionByName(least.select(*by, F.lit(0).cast("long").alias("__n"), "__id"))


def _summed(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row a group: `__n` and `__least`."""
    return _entries(rows, by).groupBy(*by).agg(F.sum("__n").alias("__n"), _least(F.collect_list("__id")).alias("__least"))


def _running(entries: DataFrame, asked: DataFrame, by: list[str], *, after: bool, strict: bool) -> DataFrame:
    """For every (by, time) asked for, the sum and the least values of the group's entries before that time, or after it."""
    none = F.lit(None).cast(entries.schema["__id"].dataType)
    both = entries.select(*by, "__t", "__n", "__id", F.lit(False).alias("__asks")).unionByName(asked.select(*by, "__t").distinct().select(
        *by, "__t", F.lit(0).cast("long").alias("__n"), none.alias("__id"), F.lit(True).alias("__asks")))
    t, asks = F.col("__t"), F.col("__asks")
    w = Window.partitionBy(*by).orderBy(t.desc() if after else t.asc(), asks.desc() if strict else asks.asc(), "__id")
    here = w.rowsBetween(Window.unboundedPreceding, 0)
    # The second smallest value so far is the smallest one that has lost against another.
    known = both.withColumn("__best", F.min("__id").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    known = known.withColumn("__lost", F.when(F.col("__id") != F.col("__best"), F.greatest("__id", "__best")))
    known = known.select(*by, "__t", "__asks", F.sum("__n").over(here).alias("__n"), F.min("__id").over(here).alias("__x"), F.min("__lost").over(here).alias("__y"))
    return known.where("__asks").select(*by, "__t", "__n", _least(F.array("__x", "__y")).alias("__least"))


def _overlap_totals(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], totals: str) -> DataFrame:
    """See `overlapping`: the b that begin inside a, and those that a begins inside of.

    An interval is longer than a slot of its level and at most two slots long, so it is the end of a slot, the beginning of the
    next one or the next but one, and the whole slot between them, if any. What lies in an end or a beginning is a running total along the slot.
    """
    left = _with_slots(a, keys, a_span)
    right = _with_slots(b.select(*keys, *b_span, F.col(totals).alias("__id")), keys, b_span).withColumn("__n", F.lit(1).cast("long"))
    by = [*keys, "__level", "__slot"]
    between = F.col("__r") - F.col("__p") == 2 * _width()

    # b begins in [start, end) of a, at the level of a.
    starts = _entries(right.select(*keys, F.col("__s").alias("__t"), "__n", "__id"), [*keys, "__t"])
    levels = left.agg(F.collect_set("__level")).scalar()
    starts = starts.withColumn("__level", F.explode(levels)).withColumn("__slot", _slot_of("__t"))
    side = lambda found, time, name: found.select(
        *keys, "__level", F.col("__t").alias(time), F.struct("__n", "__least").alias(name))
    head = side(_running(starts, left.select(*keys, "__level", F.col("__p").alias("__slot"), F.col("__s").alias("__t")), by, after=True, strict=False), "__s", "__head")
    tail = side(_running(starts, left.select(*keys, "__level", F.col("__r").alias("__slot"), F.col("__e").alias("__t")), by, after=False, strict=True), "__e", "__tail")
    middle = _summed(starts, by).select(*by, F.struct("__n", "__least").alias("__middle"))

    # a begins in (start, end) of b, at every level of b.
    levels = right.agg(F.collect_set("__level")).scalar()
    asked = left.select(*keys, F.col("__s").alias("__t")).distinct().withColumn("__level", F.explode(levels)).withColumn("__slot", _slot_of("__t"))
    at = lambda slot, time: _entries(right.select(
        *keys, "__level", F.col(slot).alias("__slot"), F.col(time).alias("__t"), "__n", "__id"), [*by, "__t"])
    over = _summed(right.where(between).select(*keys, "__level", (F.col("__p") + _width()).alias("__slot"), "__n", "__id"), by)
    columns = [*keys, "__t", "__n", "__least"]
    parts = _running(at("__p", "__s"), asked, by, after=False, strict=True).select(*columns).unionByName(
        _running(at("__r", "__e"), asked, by, after=True, strict=True).select(*columns)).unionByName(asked.join(over, by).select(*columns))
    around = parts.groupBy(*keys, F.col("__t").alias("__s")).agg(
        F.struct(F.sum("__n").alias("__n"), _least(F.flatten(F.collect_list("__least"))).alias("__least")).alias("__around"))

    met = left.withColumn("__slot", F.col("__p") + _width()).join(head, [*keys, "__level", "__s"]).join(tail, [*keys, "__level", "__e"]).join(
        around, [*keys, "__s"]).join(middle, by, "left").withColumn("__middle", F.when(between, F.col("__middle")))
    sides = [F.col(c) for c in ("__head", "__tail", "__around", "__middle")]
    n = F.lit(0).cast("long")
    for c in sides:
        n = n + F.coalesce(c["__n"], F.lit(0).cast("long"))
    none = F.array().cast(around.schema["__around"].dataType["__least"].dataType)
    return met.select(*[F.col(f"`{c}`") for c in a.columns], n.alias("n"), _least(*[F.coalesce(c["__least"], none) for c in sides]).alias("least")).where("n > 0")

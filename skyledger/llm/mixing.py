"""Mixing sources to target weights along a time-varying curriculum.

A source has a weight schedule over training time 0..1: straight lines between knots. Its integral
is the source's weight in the mix, and the integral up to t, scaled to the source's target words, is
the source's cumulative demand. The documents of a source stand in a fixed order drawn from a hash of
their id, as often as its target needs; a document is trained on at the time at which the demand reaches
the words before it, so the inverse of the demand gives its position. Sorting all uses by position by
range gives the training order.

Words before a document are sums over slots (the first hexadecimal digits of the hash) plus a running sum inside the slot, so no source,
however large, has to be in one task. Built-in functions only.

Defined cases: null and empty texts have size 0 and are never taken; null is a source of its own, the last;
repeated ids are rows of their own; a source without words has target 0; other columns are ignored by
`assign` and passed on by `mix`, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.text import WORD
from skyledger.plans.staging import stage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2
SLOT_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def schedules(sources: DataFrame, weights: Sequence[float] = WEIGHTS, tilt: float = 0.5) -> DataFrame:
    """`rank` and `knots` of every source: its weight w, repeating by rank, on a straight line from w (1 + tilt) to
    w (1 - tilt) for even ranks and the other way for odd ones. The integral is w either way."""
    if not all(w > 0 for w in weights):
        raise ValueError("weights must be above 0; leave out the documents of sources that are not wanted")
    place = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(place) - 1).cast("long")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    lean = F.when(F.col("rank") % 2 == 0, F.lit(float(tilt))).otherwise(F.lit(-float(tilt)))
    knot = lambda t, w: F.struct(F.lit(float(t)).alias("t"), w.alias("w"))
    # One row per source in one task: the table holds sources, not documents.
    return sources.withColumn("rank", rank).withColumn("knots", F.array(knot(0, weight * (1 + lean)), knot(1, weight * (1 - lean))))


def segments(knots: Column) -> Column:
    """Start, end, weights and integral so far of each piece of a schedule."""
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(knots) - 1),
        lambda i: F.struct(F.element_at(knots, i).alias("a"), F.element_at(knots, i + 1).alias("b")))
    area = lambda p: (p["b"]["t"] - p["a"]["t"]) * (p["a"]["w"] + p["b"]["w"]) / 2
    empty = F.array().cast("array<struct<t0:double,t1:double,w0:double,w1:double,before:double,upto:double>>")
    ends = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["upto"], F.lit(0.0))
    return F.aggregate(pieces, empty, lambda acc, p: F.concat(acc, F.array(F.struct(
        p["a"]["t"].alias("t0"), p["b"]["t"].alias("t1"), p["a"]["w"].alias("w0"), p["b"]["w"].alias("w1"),
        ends(acc).alias("before"), (ends(acc) + area(p)).alias("upto")))))


def time_of(demand: Column, parts: Column) -> Column:
    """The time at which the integral of a schedule reaches `demand`: the root of one straight line's area."""
    reached = F.filter(parts, lambda s: s["upto"] >= demand)
    p = F.coalesce(F.try_element_at(reached, F.lit(1)), F.element_at(parts, -1))
    rest = demand - p["before"]
    slope = (p["w1"] - p["w0"]) / (p["t1"] - p["t0"])
    under = F.greatest(p["w0"] * p["w0"] + 2 * slope * rest, F.lit(0.0))
    return F.least(p["t0"] + F.coalesce(2 * rest / F.nullif(p["w0"] + F.sqrt(under), F.lit(0.0)), F.lit(0.0)), p["t1"])


def targets(planned: DataFrame, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Adds `target` to sources with `source_size`, `weight`: shares of `share` x all words, at most `cap` x the source's.

    What capped sources leave goes to the others by weight until none is above. That fixed point fills sources
    in rising order of cap per weight: the first source whose cap exceeds its part of what is left, and all after it, are free.
    """
    w = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    upto, rest = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    filled = planned.withColumn("limit", F.col("source_size") * cap).select(
        "*", (F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
              - F.coalesce(F.sum("limit").over(upto), F.lit(0))).alias("left"), F.sum("weight").over(rest).alias("weights"))
    filled = filled.withColumn("free", F.col("weight") * F.col("left") / F.col("weights") < F.col("limit"))
    level = filled.where("free").agg(F.min_by(F.struct("left", "weights"), F.struct(F.col("limit") / F.col("weight"), "rank")).alias("level"))
    part = F.col("weight") * F.col("level.left") / F.col("level.weights")
    return filled.withColumn("level", level.scalar()).withColumn("target", F.when(F.col("free"), part).otherwise(F.col("limit").cast("double"))).drop("level", "left", "weights", "free", "limit")


def plan(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP, tilt: float = 0.5) -> DataFrame:
    """source, source_size, target, parts (schedule pieces) from rows with source and size; one row per source."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    planned = schedules(per_source, weights, tilt).withColumn("parts", segments(F.col("knots")))
    planned = planned.withColumn("weight", F.element_at("parts", -1)["upto"])
    return targets(planned, share, cap).select("source", "source_size", "target", "parts")


def _assign(rows: DataFrame, carried: list[str], *, weights: Sequence[float], share: float, cap: int, tilt: float, slot_digits: int) -> DataFrame:
    """rows: id, source, size and carried columns. Adds source_size, target, taken and uses: (position, words) of each use."""
    order = F.sha2(F.coalesce(F.col("id").cast("string"), F.lit("")), 256)
    # A source under a name that is never null, so that window and join share one shuffle.
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    keyed = rows.withColumns({"order": order, "name": name}).withColumn("slot", F.substring("order", 1, slot_digits))
    per_slot = stage(keyed.groupBy("name", "slot").agg(F.first("source").alias("source"), F.sum("size").alias("size")), "slots")
    sources = plan(per_slot, weights, share, cap, tilt)
    before = Window.partitionBy("name").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slot.select("name", "slot", "source", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    starts = stage(starts.alias("s").join(sources.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).select(
        "s.name", "s.slot", "base", "source_size", "target", "parts"), "starts")
    inside = Window.partitionBy("name", "slot").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    # A file of starts, one schedule on thousands of rows, is far smaller than its rows; the documents lie by name and slot already.
    placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts.hint("merge"), ["name", "slot"])
    at = F.col("base") + F.col("inside")
    goal = F.floor("target").cast("long")
    whole = F.element_at("parts", -1)["upto"]

    def use(epoch: Column) -> Column:
        start = at + epoch * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - start))
        return F.struct(time_of(start / F.nullif(F.col("target"), F.lit(0.0)) * whole, F.col("parts")).alias("position"), words.alias("words"))

    uses = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max(cap, 1) - 1)), lambda e: use(e.cast("long"))), lambda u: u["words"] > 0)
    found = placed.withColumns({"uses": uses, "at": at})
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda acc, u: acc + u["words"])
    return found.select(*carried, "id", "order", "size", "source_size", "target", taken.alias("taken"), "uses")


def assign(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
           weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP, tilt: float = 0.5, slot_digits: int = SLOT_DIGITS) -> DataFrame:
    """id, size, source_size, target, taken, position (of the first use, null if never taken), in the order of position.

    Sources share `share` times all words by weight; none gets more than `cap` times its own. The last use of a
    source ends at its target, in the middle of a document if need be.
    """
    sized = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), n_words(docs[text_col]).alias("size"))
    found = _assign(stage(sized, "sizes"), [], weights=weights, share=share, cap=cap, tilt=tilt, slot_digits=slot_digits)
    found = found.select("id", "size", "source_size", "target", "taken", F.try_element_at("uses", F.lit(1))["position"].alias("position"), "order")
    return found.orderBy(F.col("position").asc_nulls_last(), "order", "id").drop("order")


def _whole(found: DataFrame) -> DataFrame:
    """Uses of whole documents only; a source's words before a document (`at`) tell it from the source's others."""
    full = F.filter("uses", lambda u: u["words"] == F.col("size"))
    early = F.try_element_at(F.filter("uses", lambda u: u["words"] < F.col("size")), F.lit(1))
    slim = stage(found.select("name", "at", "size", F.size(full).alias("round"), early.alias("early")), "whole")
    # At most one a source, and at most one pick for it.
    ends = stage(slim.where("early is not null").select("name", "round", "early"), "ends")
    near = slim.drop("early").join(F.broadcast(ends), ["name", "round"]).groupBy("name").agg(
        F.min(F.struct(F.abs(F.col("size") - F.col("early.words")).alias("off"), "at", "early")).alias("pick"))
    picks = stage(near.where("pick.off < pick.early.words").select("name", "pick.at", "pick.early.position"), "picks")
    last = F.when(F.col("position").isNotNull(), F.array(F.struct("position", F.col("size").alias("words")))).otherwise(F.array())
    return found.join(F.broadcast(picks), ["name", "at"], "left").withColumn("uses", F.concat(full, last))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP, tilt: float = 0.5, slot_digits: int = SLOT_DIGITS,
        whole: bool = False) -> DataFrame:
    """The rows of `docs` in training order, one for each use; a use that ends early has the first words of the text only.

    With `whole` no text is cut: instead of a use that would end early, the source gets the document whose size is nearest
    to the words left, of those not yet used in that round, or none if that is nearer to its target.
    """
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.select(row.alias("row"), docs[id_col].alias("id"), docs[source_col].alias("source"), n_words(docs[text_col]).alias("size"))
    found = _assign(rows, ["row", "name", "at"], weights=weights, share=share, cap=cap, tilt=tilt, slot_digits=slot_digits)
    found = found.where("size > 0" if whole else "taken > 0")
    if whole:
        found = _whole(found)
    uses = found.select("row", "id", "order", "size", F.explode("uses").alias("use"))
    text = F.col("row").getField(text_col)
    # A use that ends early is its first words with one space between them.
    cut = F.when(F.col("use.words") < F.col("size"), F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("use.words").cast("int")), " ")).otherwise(text)
    ordered = uses.orderBy("use.position", "order", "id")
    return ordered.select(*[cut.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])

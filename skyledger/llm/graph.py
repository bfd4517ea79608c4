"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.plans.staging import stage


def components(links: DataFrame) -> DataFrame:
    """`node`, `component` for every end of `links` (columns a, b); a component is named by one of its nodes.

    Each round sends a node to the neighbour (or itself) that comes first in an order drawn
    from a hash of the round, joins the ends of every link with that map and drops what has
    become a loop, so the links left shrink by a constant factor a round whatever their shape.
    Both tables are written to the shared folder every round; the driver learns only whether links remain.
    """
    links = stage(links.select("a", "b").where("a <> b").distinct(), "links")
    labels, turn = None, 0
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("n"))  # noqa: E731, B023
        step = stage(
            both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("least"))
            .select(F.col("a").alias("node"), F.least("least", rank(F.col("a"))).getField("n").alias("to")), "step")
        if labels is None:
            labels = step.select("node", F.col("to").alias("component"))
        else:
            moved = step.select(F.col("node").alias("component"), "to")
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = stage(labels, "labels")
        ends = links.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        ends = ends.join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        links = stage(
            ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        turn += 1
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels

"""SimHash near-duplicates through a vantage-point tree.

A text's fingerprint has a bit where more than half of its shingle hashes have it. Equal
fingerprints are one point. The tree has one level for each slice of the 64 bits: a level's
vantage point is a fingerprint of the data, and its branches are the Hamming distances to it
inside the slice. By the triangle inequality two points that differ in d bits of a slice lie at
most d branches apart there, and the slices' distances add up to the whole one, so the branch
numbers of two points within `radius` differ by at most `radius` summed over ALL levels. A point
therefore looks only into the leaves within that total (145 of them for 8 levels and 2 bits, 73
since each pair needs one direction) instead of every leaf around its own, and each leaf it reaches
gives exact distances. Leaves are join keys, so Spark shuffles points to them and splits heavy ones.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; fewer words than a
shingle count as one shingle; repeated ids are rows of their own in one component; other columns are
ignored (`drop_copies` passes them on); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import text as X
from skyledger.llm.graph import components
from skyledger.plans.staging import stage

SHINGLE = 3
RADIUS = 2
LEVELS = 8
SEED = 42


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of each shingle of lower-cased (A-Z) words; 0 without words."""
    joined = b" ".join(raw.lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    if len(gaps) < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)][shingle - 1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(ends))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp and hash: the fingerprint as a signed long, and a hash of the text."""
    def run(found: Iterable[tuple]) -> Iterator[tuple]:
        for key, raw, digest in found:
            bits = fingerprint(raw, shingle)
            yield key, bits - (1 << 64) if bits >> 63 else bits, digest

    df = X.pick(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    kind, arrow = X.id_type(df)
    return X.map_rows(df, run, ["id", "text", "hash"], f"id {kind}, fp long, hash long",
                      pa.schema([("id", arrow), ("fp", pa.int64()), ("hash", pa.int64())]))


def moves(levels: int, radius: int) -> list[tuple[int, ...]]:
    """Branch steps of at most `radius` in sum, one of each two opposite ones, the zero step first."""
    found = [()]
    for _ in range(levels):
        found = [(*m, d) for m in found for d in range(-radius, radius + 1) if sum(map(abs, m)) + abs(d) <= radius]
    zero = (0,) * levels
    return [zero, *sorted(m for m in found if m > zero)]


def close_pairs(points: DataFrame, *, radius: int = RADIUS, levels: int = LEVELS) -> DataFrame:
    """a, b: all pairs of different fingerprints (column fp, distinct) at most `radius` bits apart.

    At most 64 + 2,016 points lie within two bits of one, so a point has a bounded number of pairs.
    """
    width = 64 // levels
    # Vantage points: one fingerprint of the data for each level, the first in the order of a hash.
    chosen = points.agg(*[F.min_by("fp", F.xxhash64(F.lit(k), "fp")).alias(f"v{k}") for k in range(levels)]).first()
    places = []
    for k in range(levels):
        mask = ((1 << width) - 1) << (k * width)
        mask = mask - (1 << 64) if mask >> 63 else mask
        places.append(F.bit_count((F.col("fp").bitwiseXOR(F.lit(chosen[k] or 0))).bitwiseAND(F.lit(mask))).cast("long"))
    base = width + 2 * radius + 1
    leaf = F.lit(0).cast("long")
    for place in places:
        leaf = leaf * base + (place + radius)
    steps = []
    for move in moves(levels, radius):
        step = 0
        for d in move:
            step = step * base + d
        steps.append(step)
    here = points.select(leaf.alias("leaf"), F.col("fp").alias("a"))
    probes = points.select(leaf.alias("own"), F.col("fp").alias("b")).select(
        F.explode(F.array(*[F.lit(s).cast("long") for s in steps])).alias("step"), "own", "b",
    ).select((F.col("own") + F.col("step")).alias("leaf"), F.expr("step = 0").alias("home"), "b")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # Spark's estimate does not know of the explode, and would broadcast probes 73 times as many as the points it takes them for.
    return (
        here.join(probes.hint("merge"), "leaf").where((apart <= radius) & (apart > 0) & (~F.col("home") | (F.col("a") < F.col("b"))))
        .select("a", "b"))


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints (id, fp, hash), and of every distinct fingerprint one that names its component, with the smallest id that has it."""
    found = stage(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    points = stage(found.groupBy("fp").agg(F.min("id").alias("least")), "points")
    labels = components(close_pairs(points.select("fp"), radius=radius, levels=levels))
    named = points.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return found, stage(named, "named")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, levels: int = LEVELS) -> DataFrame:
    """id, fp, component: the smallest id reachable through links, for every row."""
    found, named = _components(docs, id_col, text_col, shingle, radius, levels)
    least = named.groupBy("component").agg(F.min("least").alias("first"))
    of_point = named.join(least, "component").select("fp", F.col("first").alias("component"))
    return found.join(of_point, "fp").select("id", "fp", "component")


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                radius: int = RADIUS, levels: int = LEVELS) -> DataFrame:
    """One row of each component, the one with the smallest id (of rows with that id the one whose text has the smallest hash), with its columns.

    Rows that share an id but no component are different documents and each stay; a null id comes after all others.
    """
    found, named = _components(docs, id_col, text_col, shingle, radius, levels)
    # Which row of a component stays is settled on (id, hash) alone; the texts are shuffled once.
    row = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    keep = found.join(named.select("fp", "component"), "fp").groupBy("component").agg(F.min(row).alias("r")).select(
        F.col("r.id").alias("k"), F.col("r.hash").alias("h"))
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), docs[id_col].alias("id"),
                         F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("hash"))
    kept = hashed.join(keep, F.col("id").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")), "left_semi")
    return kept.dropDuplicates(["id", "hash"]).select("row.*")

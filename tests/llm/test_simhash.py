import random
import re
from itertools import combinations

import xxhash
from cases import odd, odd_texts, prose, table
from pyspark.sql import functions as F

from skyledger.llm import simhash as S
from skyledger.llm.graph import components
from skyledger.plans.staging import stage


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(prints):
    label = list(range(len(prints)))

    def root(k):
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k
    for a, b in combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            a, b = sorted((root(a), root(b)))
            label[b] = a
    return [root(k) for k in range(len(prints))]


def test_fingerprint_equals_the_definition():
    for text in odd_texts():
        assert S.fingerprint((text or "").encode()) == slow_fingerprint(text), text


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    texts = odd_texts()
    for k in range(60):
        words = prose(k, 400).split()
        for _ in range(rng.randrange(4)):
            texts.append(" ".join(words))
            words[rng.randrange(len(words))] = "changed"
    rng.shuffle(texts)
    prints = [slow_fingerprint(t) for t in texts]
    expected = reachable(prints)
    got = {r.id: (r.fp & (1 << 64) - 1, r.component) for r in S.near_duplicates(table(spark, texts)).collect()}
    assert got == {k: (p, c) for k, (p, c) in enumerate(zip(prints, expected))}
    assert len(set(expected)) < len(texts)


def test_tree_finds_every_close_pair(spark):
    rng = random.Random(5)
    points = [rng.getrandbits(64) for _ in range(40)]
    points += [p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in points] + [p ^ (1 << rng.randrange(64)) for p in points]
    points += [0, 1, 3, 7, (1 << 64) - 1, 1 << 63]
    points = sorted(set(points))
    expected = {(a, b) for a, b in combinations(points, 2) if (a ^ b).bit_count() <= 2}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    got = [tuple(sorted((r.a & (1 << 64) - 1, r.b & (1 << 64) - 1))) for r in S.close_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    wide = [tuple(sorted((r.a & (1 << 64) - 1, r.b & (1 << 64) - 1))) for r in S.close_pairs(df, radius=3, levels=4).collect()]
    assert set(wide) == {(a, b) for a, b in combinations(points, 2) if (a ^ b).bit_count() <= 3}


def test_each_pair_of_leaves_is_probed_once():
    found = S.moves(8, 2)
    assert len(found) == 73 and found[0] == (0,) * 8
    assert not {tuple(-d for d in m) for m in found[1:]} & set(found[1:])


def test_components_of_chains_stars_and_rings(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 80)] + [(2000 + k, 2000 + (k + 1) % 50) for k in range(50)] + [(5, 5), (3000, 3001), (3001, 3000)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    groups = {}
    for r in found.collect():
        groups.setdefault(r.component, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [2, 50, 80, 301]
    assert all(c in g for c, g in groups.items())


def test_odd_rows_and_empty_table(spark):
    docs = odd(spark)
    found = S.near_duplicates(docs)
    assert found.count() == docs.count() and found.where(F.col("component").isNull() & F.col("id").isNotNull()).count() == 0
    kept = S.drop_copies(docs)
    assert kept.schema == docs.schema
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    points = {t: S.fingerprint(t.encode(), S.SHINGLE) for _, t in rows}
    group = {p: p for p in points.values()}
    for _ in group:
        for a, b in combinations(group, 2):
            if (a ^ b).bit_count() <= S.RADIUS:
                group[a] = group[b] = min(group[a], group[b])
    kept_rows = [(r.doc_id, r.text or "") for r in kept.collect()]
    assert sorted(group[points[t]] for _, t in kept_rows) == sorted(set(group.values())) and set(kept_rows) <= set(rows)
    for k, t in kept_rows:  # the smallest id of its component, nulls last
        same = [i for i, x in rows if group[points[x]] == group[points[t]]]
        assert k == min(same, key=lambda i: (i is None, i or 0))
    assert S.near_duplicates(docs.limit(0)).count() == 0 and S.drop_copies(docs.limit(0)).count() == 0


def test_different_documents_under_one_id_all_stay(spark):
    docs = table(spark, [prose(1, 80), prose(2, 80), prose(3, 80), prose(1, 80)], ids=[3, 3, 1, 9])
    assert sorted((r.doc_id, r.text) for r in S.drop_copies(docs).collect()) == sorted([(3, prose(1, 80)), (3, prose(2, 80)), (1, prose(3, 80))])


def test_probes_are_not_broadcast(spark):
    """Each point is 73 probes, which Spark's size estimate leaves out."""
    points = stage(spark.range(200).select(F.xxhash64("id").alias("fp")), "points")
    text = S.close_pairs(points)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_broadcasts_stay_small(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "5m")
    try:
        assert S.near_duplicates(docs).count() == 4000
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")

import math
import re

import pytest
from cases import odd, prose, table
from pyspark.sql import functions as F

from skyledger.llm import mixing as M


def fill(sizes, weights, share=1.5, cap=2):
    """Targets by resharing what capped sources leave, again and again."""
    limit = {s: cap * n for s, n in sizes.items()}
    target, left, free = {}, share * sum(sizes.values()), set(sizes)
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total >= limit[s]}
        if not over:
            return target | {s: left * weights[s] / total for s in free}
        for s in over:
            target[s] = limit[s]
        left -= sum(limit[s] for s in over)
        free -= over
    return target


def test_targets_taken_and_order(spark):
    sizes = [300, 20, 55, 700, 10, 41, 90, 33, 500, 12] * 6
    sources = ["b", "a", None, "c", "a", "b", "d", "e", "c", "a"] * 6
    docs = table(spark, [prose(k, n) for k, n in enumerate(sizes)], sources=sources)
    rows = M.assign(docs, slot_digits=1).collect()
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", prose(k, n))) for k, n in enumerate(sizes)]
    per = {}
    for n, s in zip(words, sources):
        per[s] = per.get(s, 0) + n
    names = sorted(per, key=lambda s: (s is None, s))
    target = fill(per, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)})
    taken = {}
    for r in rows:
        s = sources[r.id]
        assert r.size == words[r.id] and r.source_size == per[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0)
        taken[s] = taken.get(s, 0) + r.taken
    assert taken == {s: math.floor(t + 1e-9) for s, t in target.items()}
    places = [r.position for r in rows if r.position is not None]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    again = {r.id: (r.taken, r.position) for r in M.assign(docs.repartition(7), slot_digits=3).collect()}
    assert {k: v[0] for k, v in again.items()}.keys() == {r.id for r in rows}
    assert again == {r.id: (r.taken, r.position) for r in M.assign(docs.repartition(2)).collect()}


def test_position_inverts_the_integral(spark):
    knots = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in ((0.0, 4.0), (0.25, 0.0), (0.5, 2.0), (1.0, 2.0))])
    df = spark.range(0, 41).select((F.col("id") / 40 * 1.75).alias("need"), M.segments(knots).alias("parts"))
    weight = lambda t: 4 - 16 * t if t < 0.25 else 8 * (t - 0.25) if t < 0.5 else 2.0
    for r in df.select("need", M.time_of(F.col("need"), F.col("parts")).alias("t")).collect():
        steps = 20_000
        area = sum(weight((k + 0.5) / steps * r.t) for k in range(steps)) / steps * r.t
        assert area == pytest.approx(r.need, abs=1e-4)


def test_the_curriculum_moves_weight_in_time(spark):
    docs = table(spark, [prose(k, 50) for k in range(200)], sources=["a", "b"] * 100)
    rows = [r for r in M.assign(docs).collect() if r.position is not None]
    early = [r.id % 2 for r in rows if r.position < 0.5]
    late = [r.id % 2 for r in rows if r.position >= 0.5]
    assert sum(early) / len(early) < sum(late) / len(late)  # the first source leans to the start


def test_mix_repeats_whole_rows_and_cuts_the_last_use(spark):
    docs = table(spark, [prose(k, 40) for k in range(30)], sources=["a"] * 20 + ["b"] * 10)
    mixed, assigned = M.mix(docs), {r.id: r for r in M.assign(docs).collect()}
    assert mixed.schema == docs.schema
    got = {}
    for r in mixed.collect():
        got.setdefault(r.doc_id, []).append(len(r.text.split()))
        assert (r.id, r.row, r.order) == ("x", "z", "o")
    assert {k: sum(v) for k, v in got.items()} == {k: r.taken for k, r in assigned.items() if r.taken}


def test_mix_of_whole_documents_ends_near_the_targets(spark):
    sources = ["a"] * 20 + ["b"] * 9 + [None]
    docs = table(spark, [prose(k, 40 + 7 * k) for k in range(30)], sources=sources)
    text, assigned = {r.doc_id: r.text for r in docs.collect()}, {r.id: r for r in M.assign(docs).collect()}
    mixed = M.mix(docs, whole=True).collect()
    assert mixed and all(r.text == text[r.doc_id] for r in mixed)
    uses = {k: 0 for k in text}
    for r in mixed:
        uses[r.doc_id] += 1
    cut = [k for k, r in assigned.items() if r.size and r.taken % r.size]
    assert cut
    for k, e in assigned.items():
        own = [r for r in assigned.values() if sources[r.id] == sources[k]]
        ends = [r for r in own if r.id in cut]
        full = {r.id: r.taken // r.size for r in own}
        more = [r for r in own if uses[r.id] > full[r.id]]
        assert len(more) <= len(ends) <= 1 and all(uses[r.id] - full[r.id] in (0, 1) for r in own)
        for end in ends:  # the nearest document of those not used in the last round, or none
            left = end.taken % end.size
            offs = [abs(r.size - left) for r in own if full[r.id] == full[end.id]]
            assert abs(sum(r.size for r in more) - left) == min(left, *offs)


def test_native_plan(spark):
    plan = M.assign(table(spark, ["a b", "c"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_slots_are_not_broadcast(spark):
    """Their file repeats one schedule for all slots of a source, which packs it far below what the rows take."""
    plan = M.assign(table(spark, ["a b", "c"]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_odd_rows_and_empty_table(spark):
    docs = odd(spark)
    rows = M.assign(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.taken == 0 and r.position is None for r in rows if r.size == 0)
    assert M.mix(docs).where("text is null or text = ''").count() == 0
    assert M.assign(docs.limit(0)).count() == 0 and M.mix(docs.limit(0)).count() == 0
    blank = table(spark, ["", None, " "])
    assert [(r.taken, r.target) for r in M.assign(blank).collect()] == [(0, 0.0)] * 3
    with pytest.raises(ValueError):
        M.assign(docs, weights=(1.0, 0.0))

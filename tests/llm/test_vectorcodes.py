import hashlib
import math
import random

import numpy as np

from skyledger.llm import vectorcodes as V

KINDS = "vec_id long, embedding array<double>, label int, id string, kind int, base long, position int, code string"
EXTRA = ("x", 7, 8, 9, "y")


def plain(rows, parts=8, entries=16, rounds=6):
    """(id, code, error, label error, codebooks) with Python's own integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // parts)
    whole = lambda v: [math.floor(4096 * x) for x in v] + [0] * (parts * width - len(v))
    kept = sorted(((r[0], whole(r[1]), r[2]) for r in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                members = [c[p] for c, a in zip(cut, at) if a[p][1] == k]
                if members:
                    books[p][k] = [sum(x) // len(members) for x in zip(*members)]
    errors = [sum(d for d, _ in a) for a in assign()]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in a), e, by_label[label], digest) for (i, _, label), a, e in zip(kept, assign(), errors)]


def made(n, dims, seed, hot=0):
    rng = random.Random(seed)
    same = [rng.gauss(0, 0.1) for _ in range(dims)]
    return [(k, same if k < hot else [rng.gauss(0, 0.1) for _ in range(dims)], rng.choice([None, 0, 1, 2])) for k in range(n)]


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], KINDS).repartition(5)
    got = sorted((tuple(r) for r in V.report(df).collect()), key=str)
    assert got == sorted(plain(rows), key=str)


def test_rows_by_plain_lloyd(spark):
    check(spark, made(300, 64, 1))


def test_hot_vectors_salts_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(V, "SALT_ROWS", 20)
    rows = made(200, 16, 2, hot=80)
    check(spark, rows + rows[70:90] + [(5, [0.5] * 16, 3), (None, [0.1] * 16, 1), (None, [0.1] * 16, None)])


def test_odd_vectors(spark):
    odd = [(900, None, 1), (901, [0.1, None] * 8, 1), (902, [float("nan")] * 16, 2), (903, [float("inf")] + [0.0] * 15, 2), (904, [], 1),
           (905, [0.25] * 3, 2), (906, [0.1] * 17, None), (907, [-1e-9] * 16, 0)]
    check(spark, made(40, 16, 3) + odd)
    check(spark, made(5, 16, 4))


def test_large_components_are_exact_and_larger_ones_saturate(spark):
    rows = [(k, [x * 3000.0 for x in v], label) for k, v, label in made(60, 16, 6)]
    check(spark, rows)
    shape = V.Shape(16, 1e308, 8, 4096)
    import pyarrow as pa
    got = shape.integers(pa.array([[1e308, -1e308] * 8], pa.list_(pa.float64())))
    assert got.tolist() == [[shape.limit, -shape.limit] * 8] and 16 * (2 * shape.limit) ** 2 < 2**63


def test_only_members_that_change_their_entry_move(spark, monkeypatch):
    moved, real = [], V.stage

    def watched(df, label):
        out = real(df, label)
        moved.append((label, out))
        return out
    monkeypatch.setattr(V, "stage", watched)
    rows = made(400, 16, 7)
    V.report(spark.createDataFrame([(*r, *EXTRA) for r in rows], KINDS))
    members = [sum(len(r.places) // 2 for r in t.where("kind = 0").collect()) for label, t in moved if label == "members"]
    assert members[0] == 400 * 8 and len(members) == 6 and all(m < 400 * 8 / 2 for m in members[1:]) and members[5] < members[1]


def test_empty_table(spark):
    df = spark.createDataFrame([], KINDS)
    assert V.report(df).columns == ["id", "code", "error", "label_error", "codebooks_sha256"] and V.report(df).count() == 0


def test_books_are_in_natural_order():
    assert V.books_text([np.array([[1, -2], [3, 4]]), np.array([[5, 6], [7, 8]])]) == "1,-2,3,4,5,6,7,8"

import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from cases import odd, odd_texts, prose, table
from pyspark.sql import functions as F

from skyledger.llm import hmm as H
from skyledger.llm.text import crc_remainder

def training():
    return crc_remainder(F.col("doc_id"), 7) != 2


def small_model(seed, states=3, classes=6):
    rng = np.random.default_rng(seed)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    return H.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((classes, states)), 0))


def paths(model, seen):
    """Every path of states with its probability."""
    for path in product(range(len(model.start)), repeat=len(seen)):
        p = model.start[path[0]] * model.emit[seen[0], path[0]]
        for a, b, x in zip(path, path[1:], seen[1:]):
            p *= model.move[a, b] * model.emit[x, b]
        yield path, p


def test_likelihood_is_the_sum_over_all_paths():
    model, rng = small_model(1), np.random.default_rng(2)
    texts = [rng.integers(0, 6, n).astype(np.int64) for n in (1, 2, 5, 7, 4, 6)]
    got = H.log_likelihoods(model, texts, length=2, together=3)
    assert got == pytest.approx([math.log(sum(p for _, p in paths(model, t))) for t in texts])


def test_long_texts_do_not_underflow_and_do_not_depend_on_segments():
    model, rng = small_model(3), np.random.default_rng(4)
    texts = [rng.integers(0, 6, n) for n in (20_000, 1, 300)]
    a, b = H.log_likelihoods(model, texts, length=128), H.log_likelihoods(model, texts, length=7, together=50)
    assert np.isfinite(a).all() and a == pytest.approx(b, rel=1e-9)


def test_expected_counts_are_those_over_all_paths():
    model, rng = small_model(5), np.random.default_rng(6)
    texts = [rng.integers(0, 6, n).astype(np.uint16) for n in (1, 4, 6, 3, 6)]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
    for t in texts:
        every = list(paths(model, t))
        total = sum(p for _, p in every)
        for path, p in every:
            start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                move[a, b] += p / total
            for s, x in zip(path, t):
                emit[x, s] += p / total
    got = H.expected_counts(model, texts)
    for a, b in zip(got, (start, move, emit)):
        assert a == pytest.approx(b, abs=1e-4)


def test_base_columns_equal_a_plain_count_and_training_helps(spark):
    texts = odd_texts() + [prose(k, 200) for k in range(80)] + [" ".join(f"{'xyz'[j % 3]}{(j * 7 + k) % 30}q" for j in range(200)) for k in range(80)]
    rows = {r.id: r for r in H.score(table(spark, texts), training(), chunk_tokens=3000).collect()}
    token = lambda t: [w.lower() for w in (t or "").encode().split()] + [b""]
    held = {k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 7 == 2}
    counts = Counter(w for k, t in enumerate(texts) if k not in held for w in token(t))
    N, V = sum(counts.values()), len(counts)
    assert set(rows) == set(range(len(texts)))
    for k, t in enumerate(texts):
        r = rows[k]
        assert (r.training, r.n_tokens, r.n_known, r.train_tokens) == (k not in held, len(token(t)), sum(counts[w] > 0 for w in token(t)), N)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (N + V + 1)) for w in token(t)))
        assert r.score < 0
    assert sum(rows[k].score for k in held) > sum(rows[k].base_score for k in held)
    again = {r.id: r.score for r in H.score(table(spark, texts).repartition(3), training(), chunk_tokens=1_000_000).collect()}
    assert all(again[k] == pytest.approx(rows[k].score, rel=1e-3) for k in rows)


def test_the_score_is_a_probability_over_words():
    """Classes sum to one, and words and the unseen type of a class sum to one."""
    model = H.initial(4, 50)
    assert model.emit.sum(axis=0) == pytest.approx(np.ones(4)) and model.move.sum(axis=1) == pytest.approx(np.ones(4))
    one = H.log_likelihoods(model, [np.array([c]) for c in range(50)])
    assert np.exp(one).sum() == pytest.approx(1)
    counts = np.array([5, 0, 3, 1])
    assert ((counts[counts > 0] + 1) / (counts.sum() + 3 + 1)).sum() + 1 / (counts.sum() + 3 + 1) == pytest.approx(1)


def test_odd_rows_and_empty_table(spark):
    docs = odd(spark)
    rows = H.score(docs, training(), iterations=1).collect()
    assert len(rows) == docs.count() and all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.id in (0, 1, 2)} == {1}
    assert H.score(docs.limit(0), training(), iterations=1).count() == 0
    none = H.score(docs, F.lit(False), iterations=1).collect()
    assert len(none) == docs.count() and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in none)


def test_a_chunk_is_coded_as_arrays(spark, monkeypatch):
    """Codes, classes and counts of every chunk, held against one word at a time; no word becomes an object of its own."""
    words = [b"", b"a", b"ab", b"abc", "é".encode(), b"\x00", b"\x00\x00", b"a\x00", "日本語".encode(), b"abxxab", b"abyyab"]
    held = pa.array([b"left out", *words], pa.large_binary())[1:]
    asked = []
    monkeypatch.setattr(H, "class_of", lambda w, classes, one=H.class_of: asked.append(w) or one(w, classes))
    got = H.classes_of(held, 300).tolist()
    assert len(asked) == len(words) - 2  # the last two have the ends of "ab"
    monkeypatch.undo()
    assert got == [H.class_of(w, 300) for w in words]

    docs = odd(spark)
    for size in (1, 500, 1 << 20):
        texts, counts = H.code(docs.coalesce(1), F.col("doc_id") % 2 == 0, classes=300, chunk_tokens=size)
        number = {(r.chunk, r.code): r for r in counts.collect()}
        found, seen = [], {}
        for r in texts.collect():
            codes = H.unpack(bytes(r.codes)).tolist()
            found.append((r.id, r.training, [number[r.chunk, c].word for c in codes]))
            assert np.frombuffer(bytes(r.classes), np.uint16).tolist() == [number[r.chunk, c]["class"] for c in codes]
            for c in codes if r.training else []:
                seen[r.chunk, c] = seen.get((r.chunk, c), 0) + 1
        lower = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
        due = [(r.doc_id, r.doc_id is not None and r.doc_id % 2 == 0, [*lower(r.text), ""]) for r in docs.collect()]
        assert sorted(found, key=str) == sorted(due, key=str)
        assert all(r.n == seen.get(k, 0) and r["class"] == H.class_of(r.word.encode(), 300) for k, r in number.items())

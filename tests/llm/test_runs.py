import hashlib
import random
import zlib

import numpy as np
from cases import odd, prose, table
from hypothesis import given, settings
from hypothesis import strategies as st

from skyledger.llm import queries, runs


def plain_runs(words, least=6, times=4):
    """Every period in turn, every maximal stretch of it; the smallest period of an interval."""
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, times * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(key, text, planted):
    words = (text or "").encode().split()
    if planted:
        h = zlib.crc32(b"" if key is None else str(key).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    left = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    return (key, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(left))), found, b" ".join(left).decode()


pieces = st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=9), st.integers(1, 9)), max_size=6)


@given(st.lists(pieces, max_size=5))
@settings(max_examples=200, deadline=None)
def test_runs_are_those_of_every_period_in_turn(texts):
    texts = [[w for part, k in t for w in part * k] for t in texts]
    for least, times in ((6, 4), (4, 3)):
        got = runs.find([np.array(t, np.int64) for t in texts], least, times)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(t, least, times) for t in texts]


@given(st.lists(st.integers(0, 1), min_size=2, max_size=60), st.integers(1, 4), st.data())
@settings(max_examples=150, deadline=None)
def test_grammar_extensions(base, times, data):
    text = base * times
    levels = runs.recompress(np.array(text, np.int64))
    pairs = data.draw(st.lists(st.tuples(st.integers(0, len(text)), st.integers(0, len(text))).filter(lambda p: p[0] < p[1]), min_size=1, max_size=20))
    i, j = np.array(pairs).T
    for (a, b), f, r in zip(pairs, runs.extend(levels, i, j, 1), runs.extend(levels, i, j, -1)):
        forward = next((k for k in range(len(text)) if b + k >= len(text) or text[a + k] != text[b + k]), 0)
        back = next((k for k in range(len(text) + 1) if k >= a or text[a - k - 1] != text[b - k - 1]), 0)
        assert (f, r) == (forward, back)


def test_levels_shrink():
    text = np.random.default_rng(1).integers(0, 50, 20_000)
    sizes = [len(level.symbols) for level in runs.recompress(text)]
    assert len(sizes) < 60 and sum(sizes) < 6 * len(text)


def repeating():
    rng = random.Random(5)
    out = []
    for k in range(30):
        unit = prose(k, rng.randint(1, 40))
        out.append(prose(k + 100, rng.randint(0, 30)) + " " + (unit + " ") * rng.randint(1, 12) + prose(k + 200, rng.randint(0, 30)))
    return out


def test_rows_and_texts_by_brute_force(spark):
    rng = random.Random(3)
    texts = repeating() + ["x " * 5, "x " * 6, "a b " * 4, "a b " * 4 + "a", " ".join(rng.choice("ab") for _ in range(300)), "word " * 3000]
    for docs in (table(spark, texts).repartition(3), odd(spark)):
        expected = [plain_row(r.doc_id, r.text, False) for r in docs.collect()]
        assert sorted((tuple(r) for r in runs.report(docs).collect()), key=str) == sorted((e[0] for e in expected), key=str)
        got = [(r.id, [tuple(x) for x in r.runs], r.text) for r in runs.collapse(docs).collect()]
        assert sorted(got, key=str) == sorted(((e[0][0], e[1], e[2]) for e in expected), key=str)


def test_a_block_border_or_slice_changes_nothing(monkeypatch):
    texts = [(k, t.encode()) for k, t in enumerate(repeating())]
    whole = [(k, r.tolist()) for k, _, _, r in runs._scan(iter(texts), None, 6, 4)]
    monkeypatch.setattr(runs, "BLOCK_WORDS", 50)
    monkeypatch.setattr(runs, "SLICE", 16)
    assert [(k, r.tolist()) for k, _, _, r in runs._scan(iter(texts), None, 6, 4)] == whole
    assert runs.number_words(b"aa bb  aa\tcc aa bb", {}).tolist() == [0, 1, 0, 2, 0, 1]


def test_the_query_plants_its_tails(spark, tmp_path):
    docs = table(spark, [prose(k, k * 3) for k in range(120)] + [None, ""])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_row(r.doc_id, r.text, True)[0] for r in docs.collect())
    assert sum(r.n_runs > 0 for r in got) > 3


def test_empty_table(spark):
    assert runs.report(table(spark, [])).count() == runs.collapse(table(spark, [])).count() == 0

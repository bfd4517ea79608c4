import random

import numpy as np
import pytest
from cases import odd, odd_texts, prose, table
from pyspark.sql import functions as F

from skyledger.llm import toxicity as T
from skyledger.llm.text import crc_remainder

def training():
    return crc_remainder(F.col("doc_id"), 5) != 0


def corpus(n, seed=0):
    rng = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        words, bad = prose(seed * 1000 + k, rng.randrange(20, 150)).split(), k % 2
        for _ in range(4 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten", "grim" + rng.choice("abcdefgh") + "o"]))
        texts.append(" ".join(words))
        labels.append(bad)
    return texts, labels


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 23, 24, 25, 40, 41, 1000):
        words = [b"w%d" % k for k in range(n)]
        x = T.Inputs([b" ".join(words)])
        assert sorted(set(x.windows.ravel().tolist()) - {0}) == list(range(1, n + 1))
        assert len(x.windows) == max(1, -(-(n - T.WINDOW + T.STRIDE) // T.STRIDE))
        flat = [w for row in x.windows.tolist() for w in row if w]
        assert n <= T.WINDOW or len(flat) > n


def test_gradients_equal_differences():
    texts, labels, weights = [b"one bad word here", b"a quiet day by the sea " * 8], np.array([1, 0]), np.array([1.0, 2.0])
    p = {k: v.astype(np.float32) for k, v in T.fresh(1).items()}
    for own in ([0], [1]):
        args = [texts[k] for k in own], labels[own], weights[own]
        windows = len(T.Inputs(args[0]).windows)
        _, g = T.gradient(p, *args)
        for name, at in (("in_f", (3, 5)), ("in_b", (2, 20)), ("loop_f", (1, 17)), ("loop_b", (2, 3)), ("bias_f", (7,)), ("look", (4,)), ("out", (9,)), ("shift", (0,))):
            if windows > 1 and name != "shift":
                continue  # shares of windows are held constant
            ends = []
            for step in (1e-2, -1e-2):
                q = {k: v.copy() for k, v in p.items()}
                q[name][at] += step
                ends.append(T.gradient(q, *args)[0])
            assert g[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-2, rel=0.03, abs=2e-5), name


def test_word_vectors_are_word_plus_mean_trigram():
    import xxhash

    p, words = T.fresh(2), [b"\xc3\xa9tat", b"a"]
    got = T.vectors(p, T.Inputs([b" ".join(words)]))
    for k, w in enumerate(words, 1):
        full = b"<" + w + b">"
        rows = [(((full[j] << 16 | full[j + 1] << 8 | full[j + 2]) * 0x9E3779B1 >> 15) & 0xFFFFFFFF) % T.GRAM_ROWS for j in range(len(full) - 2)]
        assert got[k] == pytest.approx(p["words"][xxhash.xxh32_intdigest(w) % T.WORD_ROWS] + p["grams"][rows].mean(axis=0), abs=1e-6)
    assert not got[0].any()


def test_held_out_accuracy_and_unseen_forms(spark):
    texts, labels = corpus(300)
    docs = table(spark, texts)
    known = spark.createDataFrame([(k, v) for k, v in enumerate(labels)] + [(5, None), (9999, 1)], "doc_id long, toxic int")
    p = T.train(docs, known, training())
    rows = {r.id: r for r in T.score(docs, p).collect()}
    import zlib
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(rows[k].predicted == labels[k] for k in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    # A bad word deep in a long text, past any prefix; the score is that of the worst window.
    long = (prose(1, 5000) + " vile rotten vile " + prose(2, 300)).encode()
    parts = T.text_logits(p, [long, prose(1, 5000).encode()])
    assert parts[0] > 0 > parts[1]
    assert T.text_logits(p, [b""])[0] < 0


def test_training_rows_are_bounded_and_do_not_hold_the_others(spark):
    texts, labels = corpus(60, 3)
    known = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    got, target = T.sample(table(spark, texts), known, training(), id_col="doc_id", text_col="text", label_col="toxic", max_rows=7)
    assert target.count(0) == target.count(1) == 7
    import zlib
    held = {texts[k].encode() for k in range(60) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert not held & set(got)


def test_odd_rows_and_empty_tables(spark):
    docs = odd(spark)
    p = T.fresh()
    rows = T.score(docs, p).collect()
    assert len(rows) == docs.count() and len({r.score for r in rows if r.id in (0, 1, 2)}) == 1
    none = spark.createDataFrame([], "doc_id long, toxic int")
    flat = T.score(docs, T.train(docs, none, training())).collect()
    assert {r.predicted for r in flat} == {0} and len({r.score for r in flat}) == 1
    assert T.score(docs.limit(0), p).count() == 0
    one, many = T.text_logits(p, [odd_texts()[12].encode()]), T.text_logits(p, [(t or "").encode() for t in odd_texts()])
    assert one[0] == pytest.approx(many[12], abs=1e-5)

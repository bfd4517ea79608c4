import random

from cases import VOCABULARY, odd, prose, table

from skyledger.llm import decontam as D


def slow_distance(item, passage):
    """Least edits from the item to any part of the passage."""
    row = [0] * (len(passage) + 1)
    for k, a in enumerate(item, 1):
        new = [k]
        for j, b in enumerate(passage, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def item_texts(n, seed=0):
    rng = random.Random(seed)
    return [" ".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") + rng.choice("nrst") + rng.choice(["", "ing", "ed", "ly"]) for _ in range(rng.randrange(12, 60))) for _ in range(n)]


def edited(words, edits, rng):
    out = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.5:
            out[at] = rng.choice(VOCABULARY).strip(",.") + "x"
        elif kind < 0.75 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, "extra")
    return out


def bench(spark, texts, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], t, "x") for k, t in enumerate(texts)], "item_id long, text string, id string")


def test_edit_distance_equals_the_full_table():
    rng = random.Random(2)
    for _ in range(60):
        a = [bytes([97 + rng.randrange(4)]) for _ in range(rng.randrange(1, 12))]
        b = [bytes([97 + rng.randrange(4)]) for _ in range(rng.randrange(0, 16))]
        assert D.edit_distance(D.numbers(a), D.numbers(b))[0] == slow_distance(a, b)


def test_recall_reaches_its_target_at_every_edit_rate():
    rng = random.Random(7)
    items = [(k, D.tokens(t.encode())) for k, t in enumerate(item_texts(120))]
    index = D.Index(items, D.MAX_EDITS, D.RECALL)
    for rate in (0, 0.05, 0.1, 0.15, 0.2):
        texts, due = [], []
        for k, ws in items:
            passage = edited(ws, int(rate * len(ws)), rng)
            around = [w.encode() for w in prose(k, 150).split()]
            whole = around[:90] + [p if isinstance(p, bytes) else p.encode() for p in passage] + around[90:]
            texts.append(b" ".join(whole))
            due.append(slow_distance(ws, D.tokens(texts[-1])) <= int(D.MAX_EDITS * len(ws)))
        got = {(t, i) for t, i, _, _ in index.find(texts)}
        recall = sum((k, k) in got for k, d in enumerate(due) if d) / sum(due)
        assert recall >= D.RECALL, (rate, recall)
        for t, i in got:  # every row is within the limit, by the full table
            assert slow_distance(items[i][1], D.tokens(texts[t])) <= int(D.MAX_EDITS * len(items[i][1]))


def test_edits_aimed_at_the_anchors_are_found():
    items = [(k, ws) for k, t in enumerate(item_texts(120, 3)) if len(ws := D.tokens(t.encode())) >= 25]
    index = D.Index(items, D.MAX_EDITS, D.RECALL)
    common = {w: sum(ws.count(w) for _, ws in items) for _, ws in items for w in ws}
    for aim in (lambda w: (-len(w), w), lambda w: (common[w], -len(w), w)):
        texts = []
        for k, ws in items:
            out, left = list(ws), int(D.MAX_EDITS * len(ws))
            for at in sorted(range(len(ws)), key=lambda at: aim(ws[at]))[:left]:
                out[at] = b"zzz%d" % at
            around = [w.encode() for w in prose(k, 150).split()]
            texts.append(b" ".join(around[:90] + out + around[90:]))
        got = {(t, i) for t, i, _, _ in index.find(texts)}
        assert sum((k, k) in got for k in range(len(items))) >= D.RECALL * len(items)


def test_rows_equal_brute_force(spark):
    items = item_texts(15, 4)
    texts = [prose(k, 200) for k in range(20)]
    texts[3] = texts[3][:300] + " " + items[2].upper().replace(" ", ",  ") + " " + texts[3][300:]
    texts[5] = items[7]
    texts[6] = items[1] + "\n" + items[9]
    texts[8] = " ".join(items[4].split()[:-6]) + " " + prose(1, 30)
    found = D.matches(table(spark, texts), bench(spark, items)).collect()
    expected = set()
    for k, t in enumerate(texts):
        for i, item in enumerate(items):
            ws = D.tokens(item.encode())
            edits = slow_distance(ws, D.tokens(t.encode()))
            if edits <= int(0.2 * len(ws)):
                expected.add((k, i, edits, len(ws)))
    assert {(r.id, r.item, r.edits, r.n_words) for r in found} == expected and len(found) == len(expected) >= 4
    blocks = D.matches(table(spark, texts), bench(spark, items), block_bytes=600).collect()
    assert {(r.id, r.item, r.edits) for r in blocks} == {(r.id, r.item, r.edits) for r in found}


def test_clean_keeps_the_others_whole(spark):
    items = item_texts(5, 9)
    texts = ["clean " + prose(1, 80), items[0], "x " + items[1] + " y", None, ""]
    docs = table(spark, texts, ids=[1, 2, None, 4, 5])
    kept = D.clean(docs, bench(spark, items))
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]
    assert kept.first().row == "z"


def test_odd_rows_and_empty_tables(spark):
    docs = odd(spark)
    items = bench(spark, [None, "", "...", "two words", "one", "café ñandú größe über straße", "two words"], ids=[None, 1, 2, 3, 4, 5, 3])
    rows = D.matches(docs, items).collect()
    assert {(r.id, r.item) for r in rows} == {(4, 3), (3, 4)}
    assert sum((r.id, r.item) == (4, 3) for r in rows) == 2  # a repeated item gives rows of its own
    assert D.matches(docs, items.limit(0)).count() == 0 and D.matches(docs.limit(0), items).count() == 0
    assert D.clean(docs, items.limit(0)).count() == docs.count()

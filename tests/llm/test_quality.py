import re
from collections import Counter

from cases import odd, odd_texts, table

from skyledger.llm import quality as Q


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_features_and_verdicts_equal_a_plain_count(spark):
    texts = odd_texts() + ["a b c a b c " * 40, "w%d " * 60 + "\n", "\n".join(f"word{k} x{k} y{k}" for k in range(40)), "x " * 3 + "\ny"]
    rows = {r.id: r for r in Q.judge(table(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        r = rows[k]
        n, chars, symbols, dup, repeat = base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), text
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.kept and r.base_failed)
        if 10 * symbols > n:
            assert not r.kept


def test_filter_keeps_whole_rows_and_agrees_with_the_verdicts(spark):
    docs = odd(spark)
    kept = Q.filter_documents(docs)
    assert kept.schema == docs.schema
    expected = sorted((str(r.id)) for r in Q.judge(docs).where("kept").collect())
    assert sorted(str(r.doc_id) for r in kept.collect()) == expected and expected


def test_empty_table(spark):
    docs = odd(spark).limit(0)
    assert Q.judge(docs).count() == 0 and Q.filter_documents(docs).count() == 0


def test_rules_run_by_rejections_per_second_and_later_ones_are_skipped():
    ran = []
    rules = (Q.Rule("dear", lambda t: ran.append("dear") or True), Q.Rule("cheap", lambda t: ran.append("cheap") or True), Q.Rule("never", lambda t: False))
    cascade = Q.order(rules, [("dear", 0.5, 1e-3), ("cheap", 0.4, 1e-6), ("never", 0.0, 1e-9)])
    assert [r.name for r in cascade] == ["cheap", "dear", "never"]
    assert Q.rejected_by(Q.Text(b"x"), cascade) == "cheap" and ran == ["cheap"]


def test_measured_on_a_sample(spark):
    found = {name: share for name, share, _ in Q.measure(table(spark, ["short"] * 30 + ["good words here " * 1 + " ".join(f"w{k}" for k in range(80))] * 10))}
    assert found["short"] > 0 and found["symbols"] == 0

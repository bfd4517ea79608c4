import numpy as np
import pytest
from cases import odd, odd_texts, prose, table
from tokenizers import Tokenizer

from skyledger.llm import attribution as A
from skyledger.llm.queries import tokenizer_path

PATH = tokenizer_path()


def whole_offsets(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).offsets


def slow(text, spans, boundary):
    """Section of each token by looking at every section."""
    out = []
    for a, b in whole_offsets(text):
        met = [(k, min(b, z) - max(a, y)) for k, (y, z) in enumerate(spans) if min(b, z) > max(a, y)]
        if not met:
            out.append(-1)
        elif boundary == "longest":
            out.append(max(met, key=lambda m: (m[1], -m[0]))[0])
        else:
            out.append(met[0 if boundary == "start" else -1][0])
    return out


def test_spans_are_those_of_the_whole_text():
    for text in [t or "" for t in odd_texts()] + ["é́ à x", "don't\x0bstop", "\xa0a\x85b", "日本 語"]:
        starts, ends = A.spans_of(text.encode(), PATH)
        assert list(zip(starts.tolist(), ends.tolist())) == whole_offsets(text), text[:40]


@pytest.mark.parametrize("boundary", A.RULES)
def test_allocation_equals_looking_at_every_section(boundary):
    text = prose(3, 120).replace("\n", " ")
    rng = np.random.default_rng(0)
    for _ in range(20):
        cuts = np.unique(rng.integers(0, len(text) + 1, 14))
        spans = [(int(a), int(b)) for a, b in zip(cuts, cuts[1:]) if rng.random() < 0.8]
        spans += [(len(text), len(text))]
        starts, ends = A.spans_of(text.encode(), PATH)
        assert A.allocate(starts, ends, np.array(spans), boundary).tolist() == slow(text, spans, boundary)


def test_sections_add_up(spark):
    texts = [t or "" for t in odd_texts()]
    rows = A.sections(table(spark, odd_texts()), tokenizer=PATH).collect()
    for k, text in enumerate(texts):
        own = sorted((r for r in rows if r.id == k), key=lambda r: r.section)
        assert sum(r.n_tokens for r in own) == len(whole_offsets(text))
        spans = A.line_spans(text)
        assert [(r.start, r.end) for r in own] == spans and "".join(text[a:b] for a, b in spans) == text
        expected = np.bincount(slow(text, spans, "start") or [0], minlength=len(spans)) if text.strip() else np.zeros(len(spans))
        if len(text) < 5000:
            assert [r.n_tokens for r in own] == expected.tolist()


def test_text_outside_sections_is_counted_apart(spark):
    docs = table(spark, ["aaa bbb ccc"])
    for boundary in A.RULES:
        rows = A.sections(docs, tokenizer=PATH, boundary=boundary, spans=lambda t: [(4, 7)]).collect()
        assert sum(r.n_tokens for r in rows) == len(whole_offsets("aaa bbb ccc")) and {r.section for r in rows} == {0, -1}
    with pytest.raises(ValueError):
        A.allocate(np.array([0]), np.array([1]), np.array([[0, 1]]), "middle")


def test_boundary_rules_differ_on_a_crossing_token():
    starts, ends, spans = np.array([2]), np.array([9]), np.array([[0, 4], [4, 8], [8, 12]])
    assert [A.allocate(starts, ends, spans, b).tolist() for b in A.RULES] == [[0], [2], [1]]


def test_fields_of_a_row(spark):
    df = spark.createDataFrame([(1, "user", "hello there friend"), (2, None, ""), (None, "a", None)], "id long, role string, text string")
    rows = A.fields(df, ["role", "text"], tokenizer=PATH, id_col="id").collect()
    got = {(r.id, r.field): r.n_tokens for r in rows}
    assert len(rows) == 6 and got[1, "role"] == len(whole_offsets("user")) and got[1, "text"] == len(whole_offsets("hello there friend"))
    assert got[2, "role"] == got[2, "text"] == got[None, "text"] == 0


def test_odd_rows_and_empty_table(spark):
    docs = odd(spark)
    assert A.sections(docs, tokenizer=PATH).select("id").distinct().count() == docs.select("doc_id").distinct().count()
    assert A.sections(docs.limit(0), tokenizer=PATH).count() == 0

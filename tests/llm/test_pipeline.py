"""The pipeline against plain Python, stage by stage, and as a whole."""
import random
import re
import zlib

import pytest
from cases import prose
from test_decontam import bench, item_texts
from test_quality import base
from test_simhash import reachable, slow_fingerprint
from test_tokenfiles import plain

import corpus_pipeline as P

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(1)
    items = item_texts(6, 21)
    texts = [prose(k, rng.randrange(60, 200)) for k in range(40)]
    texts += [texts[3], texts[3], texts[9].upper(), texts[4] + " end"]  # copies
    texts += [prose(90, 60) + " " + items[2] + " " + prose(91, 60), items[4] + " " + prose(92, 80)]  # leaks
    texts += [None, "", "short text", "a b c " * 60, "w #$% " * 80]  # junk
    return items, [(k, t, "en", "abc"[k % 3] if k % 7 else None, None) for k, t in enumerate(texts)]


def plain_pipeline(items, rows):
    """Ids that every filter keeps, without the mixing."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    kept = []
    for r in rows:
        n, chars, symbols, dup, repeat = base(r[1])
        lines = [x for x in (r[1] or "").split("\n") if x.strip()]
        if n >= 50 and 100 * repeat <= 50 * n and 10 * symbols <= n and 10 * dup <= 6 * len(lines) and 2 * n <= chars <= 14 * n:
            kept.append(r)
    roots = reachable([slow_fingerprint(r[1]) for r in kept])
    kept = [r for k, r in enumerate(kept) if roots[k] == k]
    return [r for r in kept if not any(i in " ".join(words(r[1])) for i in items)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    items, rows = corpus()
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, KINDS).write.parquet(f"{path}/documents.parquet")
    bench(spark, items).select("item_id", "text").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_in_order_return_documents():
    assert [n.split()[0] for n, _ in P.STAGES] == ["quality", "SimHash", "benchmark", "mixing", "token-ID"]


def test_pipeline_equals_plain_python(spark, folder):
    items, rows = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema, kept = docs.schema, None
    for k, (name, step) in enumerate(P.STAGES[:4]):
        docs = step(spark, docs, folder)
        assert docs.schema == schema, name
        docs = spark.createDataFrame(docs.collect(), schema)
        if k == 2:
            kept = sorted(r.doc_id for r in docs.collect())
    expected = plain_pipeline(items, rows)
    assert kept == [r[0] for r in expected]
    mixed = docs.collect()
    text = {r[0]: r[1] for r in rows}
    assert {r.doc_id for r in mixed} <= set(kept) and all(text[r.doc_id].split()[:5] == r.text.split()[:5] for r in mixed)
    assert sum(len(r.text.split()) for r in mixed) == pytest.approx(1.5 * sum(len(text[k].split()) for k in kept), abs=len(rows))
    got = sorted(P.run(spark, folder).collect(), key=lambda r: r.start)
    ordered = sorted(mixed, key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [r.doc_id for r in ordered]
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(raw) for raw in plain([r.text for r in ordered]))
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]


def test_mixed_texts_are_the_originals(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("length(text) > 300")
    text = {r.doc_id: r.text for r in docs.collect()}
    mixed = P.mixing_sources(spark, docs, folder).collect()
    assert mixed and all(r.text == text[r.doc_id] for r in mixed)


def test_empty_table_through_every_stage(spark, folder, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], KINDS).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    assert P.run(spark, path).count() == 0

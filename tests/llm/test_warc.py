import base64
import hashlib
import json

import pytest

from skyledger.llm import warc as W

PAGES = [(1, "https://a.example/x", "<title> A &amp; B</title><p>one</p><a href='/l?a=1&amp;b'>two</a>", "k"), (2, None, "<p>x", "k"), (3, "http://b/\r\nWARC-Type: warcinfo", None, "k"),
         (4, "http://c/", "", "k"), (1, "https://a.example/x", "<title> A &amp; B</title><p>one</p><a href='/l?a=1&amp;b'>two</a>", "k"), (None, "u", "é" * 50_000 + "\r\n\r\nWARC/1.1\r\n", "k")]


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_derivatives_link_back_to_their_source(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, id string")
    sources = W.responses(pages)
    held = [(r.id, *next(W.load(bytes(r.record)))) for r in sources.collect()]
    by_id = {W.get(h, "WARC-Record-ID"): (h, b) for _, h, b in held}
    rows = W.derivatives(sources).collect()
    assert len(rows) == 2 * len(PAGES)
    for r in rows:
        (headers, block), = W.load(bytes(r.record))
        source, original = by_id[r.refers_to]
        assert W.get(headers, "WARC-Refers-To") == W.get(source, "WARC-Record-ID")
        for name in ("WARC-Target-URI", "WARC-Date"):
            assert W.get(headers, name) == W.get(source, name)
        assert r.block_digest == sha(block) and r.length == len(block) == int(W.get(headers, "Content-Length"))
        if r.record_type == "metadata":
            about = json.loads(block)
            assert [tuple(h) for h in about["warc_headers"]] == source
            assert about["payload_digest"] == W.get(source, "WARC-Payload-Digest") == sha(original.partition(b"\r\n\r\n")[2])
            assert about["block_digest"] == sha(original) and about["payload_digest_matches"]
    ids = {r.record_id for r in rows}
    assert len(ids) == 2 * (len(PAGES) - 1)  # the repeated page gives equal records
    assert sorted(map(tuple, W.derivatives(sources.repartition(3)).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert W.derivatives(sources.limit(0)).count() == 0 == W.responses(pages.limit(0)).count()


def test_metadata_and_conversion_of_a_page():
    meta, text = W.derive(*W.response("1", PAGES[0][1], PAGES[0][2].encode()))
    about = json.loads(meta[1])
    assert about["response"]["title"] == "A & B" and about["response"]["links"] == ["/l?a=1&b"] and about["response"]["status"] == "HTTP/1.1 200 OK"
    assert dict(map(tuple, about["response"]["http_headers"]))["Content-Type"] == "text/html; charset=utf-8"
    assert text[1] == b"one\ntwo" and W.get(text[0], "WARC-Type") == "conversion"


def test_files_of_many_records_round_trip_and_headers_hold_no_breaks():
    made = [W.response(str(k), u or "", (h or "").encode()) for k, (_, u, h, _) in enumerate(PAGES)]
    assert list(W.load(b"".join(W.dump(*m) for m in made))) == made
    assert W.get(made[2][0], "WARC-Target-URI") == "http://b/ WARC-Type: warcinfo"
    with pytest.raises(ValueError):
        list(W.load(b"junk\r\n\r\n"))


def test_sources_without_http_or_text():
    bare = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")]
    meta, text = W.derive(bare, b"<p>plain page")
    assert text[1] == b"plain page" and json.loads(meta[1])["response"]["status"] == ""
    image = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG<p>x"
    meta, text = W.derive(bare, image)
    assert text[1] == b"" and json.loads(meta[1])["payload_length"] == 8


def test_other_record_types_are_passed_over(spark):
    data = W.dump([("WARC-Type", "request"), ("Content-Length", "1")], b"x") + W.dump(*W.response("1", "u", b"<p>y"))
    df = spark.createDataFrame([(1, bytearray(data)), (2, None)], "id long, record binary")
    assert [r.record_type for r in W.derivatives(df).collect()] == ["metadata", "conversion"]


def test_pages_that_share_id_and_url_have_records_of_their_own(spark):
    rows = [("1", "u", "<p>a"), ("1", "u", "<p>b"), ("1", "u", "<p>a"), (None, "u", "<p>a"), ("None", "u", "<p>a"), ("null", "u", "<p>a")]
    sources = W.responses(spark.createDataFrame(rows, "page_id string, url string, html string"))
    names = {r.id: set() for r in sources.collect()}
    for r in sources.collect():
        names[r.id].add(W.get(next(W.load(bytes(r.record)))[0], "WARC-Record-ID"))
    assert len(names["1"]) == 2 and len(set().union(*names.values())) == 5
    assert W.derivatives(sources).select("record_id").distinct().count() == 10

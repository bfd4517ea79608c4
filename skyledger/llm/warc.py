"""WARC records: responses from pages, and metadata and plain-text conversion records derived from responses.

A derived record names its source in WARC-Refers-To, keeps the source's target and date, and the metadata record holds all of the source's WARC and HTTP
headers and its digests, so either can be traced back and checked against the source. Record ids are made from the page's id, url and
payload digest, so a job that runs again makes the same records, and pages that share id and url but not their html have records of their own. Records are built where the rows lie; there is no shuffle.

Defined cases: a null page has an empty body, a null url an empty target; repeated rows give equal records; a null id is not the text "None";
other columns are ignored; a response without an HTTP header block, or that is not text, has a metadata record with what there is and an empty
conversion; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import text as X
from skyledger.llm.markup import blocks, links, title

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:skyledger:warc")

Headers = list[tuple[str, str]]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, chr(0).join(parts))}>"


def one_line(value: str) -> str:
    """A header value: no line breaks."""
    return " ".join(value.split())


def dump(headers: Headers, block: bytes) -> bytes:
    """One record as it stands in a file."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def load(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """The records of a file, one by one, by their Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError("a record must begin with its version")
        headers = [tuple(x.strip() for x in line.decode().split(":", 1)) for line in lines]
        size = int(get(headers, "Content-Length") or 0)
        yield headers, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def get(headers: Headers, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def response(key: str, url: str, body: bytes, date: str = DATE) -> tuple[Headers, bytes]:
    """A response record around a page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http + body
    return [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url, digest(body))), ("WARC-Date", date), ("WARC-Target-URI", one_line(url)),
            ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(block)))], block


def split_http(block: bytes) -> tuple[str, Headers, bytes]:
    """Status line, headers and payload of an HTTP response; the whole block is payload if there is no header block."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines)], payload


def _derived(kind: str, source: Headers, content_type: str, block: bytes) -> tuple[Headers, bytes]:
    origin = get(source, "WARC-Record-ID") or ""
    return [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, origin)), ("WARC-Date", get(source, "WARC-Date") or ""),
            ("WARC-Target-URI", get(source, "WARC-Target-URI") or ""), ("WARC-Refers-To", origin), ("WARC-Block-Digest", digest(block)),
            ("Content-Type", content_type), ("Content-Length", str(len(block)))], block


def derive(headers: Headers, block: bytes) -> list[tuple[Headers, bytes]]:
    """The metadata and the conversion record of a response."""
    status, http, payload = split_http(block)
    kind = (get(http, "Content-Type") or "").lower()
    page = payload.decode("utf-8", "replace") if not http or kind.startswith("text/") or "html" in kind else ""
    found = {"status": status, "http_headers": [list(h) for h in http], "title": title(page), "links": links(page)}
    about = {
        "warc_headers": [list(h) for h in headers], "payload_length": len(payload), "payload_digest": digest(payload), "block_digest": digest(block),
        "payload_digest_matches": get(headers, "WARC-Payload-Digest") in (None, digest(payload)), "response": found}
    text = "\n".join(b.text for b in blocks(page))
    return [_derived("metadata", headers, "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True).encode()),
            _derived("conversion", headers, "text/plain; charset=utf-8", text.encode())]


_COLUMNS = ["record_type", "record_id", "refers_to", "target_uri", "content_type", "block_digest"]


def _row(headers: Headers, block: bytes) -> tuple:
    names = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "Content-Type", "WARC-Block-Digest")
    return (*(get(headers, n) for n in names), len(block), dump(headers, block))


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """id and record (bytes) of a response record for every page."""
    df = pages.select(pages[id_col].alias("id"), *[F.coalesce(pages[c].cast("string"), F.lit("")).alias(n) for c, n in ((url_col, "url"), (html_col, "html"))])
    kind, arrow = X.id_type(df)

    def run(found: Iterable[tuple]) -> Iterator[tuple]:
        for key, url, body in found:
            name = "null" if key is None else f"id {key.decode() if isinstance(key, bytes) else key}"
            yield key, dump(*response(name, url.decode(), body, date))

    return X.map_rows(df, run, ["id", "url", "html"], f"id {kind}, record binary", pa.schema([("id", arrow), ("record", pa.binary())]), 256)


def derivatives(records: DataFrame, *, id_col: str = "id", record_col: str = "record") -> DataFrame:
    """Two rows for every response in `record_col`: record_type, record_id, refers_to, target_uri, content_type, block_digest, length, record.

    Records of other types are passed over.
    """
    df = records.select(records[id_col].alias("id"), F.coalesce(records[record_col], F.lit(b"")).alias("source"))
    kind, arrow = X.id_type(df)

    def run(found: Iterable[tuple]) -> Iterator[tuple]:
        for key, data in found:
            for headers, block in load(data):
                if get(headers, "WARC-Type") == "response":
                    for made in derive(headers, block):
                        yield key, *_row(*made)

    return X.map_rows(df, run, ["id", "source"], f"id {kind}, {', '.join(f'{c} string' for c in _COLUMNS)}, length long, record binary",
                      pa.schema([("id", arrow), *[(c, pa.string()) for c in _COLUMNS], ("length", pa.int64()), ("record", pa.binary())]), 256)

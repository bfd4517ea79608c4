"""Token counts of a text's sections from one encoding of the whole text.

A text is encoded once (each of its words, remembered from text to text), with the character span of every token. Sections (lines by default, or any spans of the text)
and tokens are both in text order, so an interval join of the two is a binary search. A token that lies in one section
counts there; one that crosses a boundary goes to a section by the rule `boundary`: "start" (where it begins),
"end" (where it ends) or "longest" (the section with most of its characters, the earlier one of equals). A token
that touches no section (text between spans) counts as outside. So the sections' tokens and the outside ones add up to the text's.

Defined cases: null and empty texts have one empty section and no tokens; repeated ids are rows of their own; other columns are ignored by
`sections`; fields that are null count as empty; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import text as X
from skyledger.llm.tokenfiles import Encoder

MEMO_WORDS = 700_000
RULES = ("start", "end", "longest")
OUTSIDE = -1


def line_spans(text: str) -> list[tuple[int, int]]:
    """Character spans of the lines, each with the newline that ends it."""
    ends = np.cumsum([len(line) + 1 for line in text.split("\n")]).tolist()
    ends[-1] -= 1
    if len(ends) > 1 and ends[-1] == ends[-2]:
        ends.pop()
    return list(zip([0, *ends[:-1]], ends))


def allocate(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray, boundary: str = "start") -> np.ndarray:
    """Section of each token, or OUTSIDE. Spans are (start, end) rows in text order that do not overlap; tokens may be empty."""
    if boundary not in RULES:
        raise ValueError(f"boundary must be one of {RULES}")
    if not len(spans):
        return np.full(len(starts), OUTSIDE)
    # Empty sections hold nothing; tokens are joined with the others.
    solid = np.flatnonzero(spans[:, 1] > spans[:, 0])
    if not len(solid):
        return np.full(len(starts), OUTSIDE)
    left, right = spans[solid, 0], spans[solid, 1]
    last = np.maximum(ends - 1, starts)  # place of the last character
    first_hit = np.searchsorted(right, starts, "right")  # first section that ends behind the token's start
    last_hit = np.searchsorted(left, last, "right") - 1  # last section that begins at or before its last character
    touched = first_hit <= last_hit
    if boundary == "start":
        choice = first_hit
    elif boundary == "end":
        choice = last_hit
    else:
        choice = first_hit.copy()
        for t in np.flatnonzero(touched & (last_hit > first_hit)):
            own = np.arange(first_hit[t], last_hit[t] + 1)
            shared = np.minimum(right[own], ends[t]) - np.maximum(left[own], starts[t])
            choice[t] = own[shared.argmax()]
    return np.where(touched, solid[np.clip(choice, 0, len(solid) - 1)], OUTSIDE)


class Offsets(Encoder):
    """Character spans of tokens inside their words, in place of ids."""

    width = 8

    def packed(self, got) -> bytes:
        return np.array(got.offsets, "<i4").tobytes()


_encoders: dict[str, Offsets] = {}


def spans_of(raw: bytes, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Character starts and ends of the whole text's tokens.

    The tokenizer never looks across blanks, so a token's span is its span in its word, moved by the word's start.
    """
    if path not in _encoders:
        _encoders[path] = Offsets(path, MEMO_WORDS)
    parts = _encoders[path].parts(raw.split())
    table = np.frombuffer(b"".join(parts), "<i4").reshape(-1, 2).astype(np.int64)
    chars = np.frombuffer(raw, np.uint8)
    solid = (chars != 32) & ((chars < 9) | (chars > 13))
    begins = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]])) if len(chars) else np.zeros(0, np.int64)
    place = np.cumsum((chars & 0xC0) != 0x80) - 1  # character that a byte belongs to
    shift = np.repeat(place[begins], np.fromiter((len(p) // 8 for p in parts), np.int64, len(parts)))
    return table[:, 0] + shift, table[:, 1] + shift


def sections(docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", boundary: str = "start",
             spans: Callable[[str], list[tuple[int, int]]] = line_spans) -> DataFrame:
    """id, section (its number), start, end (characters), n_tokens, n_crossing (of those, tokens that reach beyond it).

    Text outside all sections is section -1 with null spans, if it has tokens.
    """
    df = X.pick(docs, id_col, text_col)
    kind, arrow = X.id_type(df)

    def run(found: Iterable[tuple]) -> Iterator[tuple]:
        for key, raw in found:
            starts, ends = spans_of(raw, tokenizer)
            table = np.array(spans(raw.decode()), np.int64).reshape(-1, 2)
            own = allocate(starts, ends, table, boundary)
            inside = own >= 0
            counts = np.bincount(own[inside], minlength=len(table))
            beyond = inside.copy()
            beyond[inside] = (starts[inside] < table[own[inside], 0]) | (ends[inside] > table[own[inside], 1])
            crossing = np.bincount(own[beyond], minlength=len(table))
            for k, ((a, b), n, c) in enumerate(zip(table.tolist(), counts.tolist(), crossing.tolist())):
                yield key, k, a, b, n, c
            if not inside.all():
                yield key, OUTSIDE, None, None, int((~inside).sum()), 0

    names = ["section", "start", "end", "n_tokens", "n_crossing"]
    return X.map_rows(df, run, ["id", "text"], f"id {kind}, section int, start long, end long, n_tokens long, n_crossing long",
                      pa.schema([("id", arrow), ("section", pa.int32()), *[(c, pa.int64()) for c in names[1:]]]))


def fields(rows: DataFrame, columns: list[str], *, tokenizer: str, id_col: str, separator: str = "\n", boundary: str = "start") -> DataFrame:
    """id, field, n_tokens, n_crossing: tokens of each of several string columns, joined by `separator` and encoded as one text.

    A separator belongs to the field before it.
    """
    kind, arrow = X.id_type(rows.select(rows[id_col].alias("id")))
    df = rows.select(rows[id_col].alias("id"), *[F.coalesce(rows[c].cast("string"), F.lit("")).alias(f"f{k}") for k, c in enumerate(columns)])

    def run(found: Iterable[tuple]) -> Iterator[tuple]:
        for key, *parts in found:
            texts = [p.decode() for p in parts]
            sizes = [len(t) + len(separator) for t in texts]
            sizes[-1] -= len(separator)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            starts, ends = spans_of(separator.join(texts).encode(), tokenizer)
            table = np.stack([edges[:-1], edges[1:]], axis=1)
            own = allocate(starts, ends, table, boundary)
            inside = own >= 0
            beyond = inside & ((starts < edges[own]) | (ends > edges[own + 1]))
            for name, n, c in zip(columns, np.bincount(own[inside], minlength=len(table)).tolist(), np.bincount(own[beyond], minlength=len(table)).tolist()):
                yield key, name, n, c

    return X.map_rows(df, run, df.columns, f"id {kind}, field string, n_tokens long, n_crossing long",
                      pa.schema([("id", arrow), ("field", pa.string()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())]))

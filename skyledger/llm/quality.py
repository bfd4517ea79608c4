"""Quality rules as a short-circuit cascade.

Every rule looks at one text and says whether it rejects it. Rules share lazily computed
features, so a rule that is never reached costs nothing. On a bounded sample each rule's
seconds per text and share of rejections are measured, and the rules run in falling order
of rejections per second; the verdict (kept only if no rule rejects) does not depend on the order.

Defined cases: null and empty texts have no words and are rejected by `short`; repeated ids are
judged one by one; an empty table gives an empty result; other columns are ignored or, in
`filter_documents`, passed on whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import text as X

SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = X.SPACE + bytes(range(0x80, 0xC0))  # blanks, and all but the first byte of a code point


class Text:
    """Features of one text, each computed when first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return X.words(self.raw)

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, _NOT_COUNTED))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line.strip(X.SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a window of three that is found twice or more."""
        n = len(self.words)
        number: dict[bytes, int] = {}
        codes = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, n)
        if n < 4 or len(number) == n:
            return 0
        pairs = np.unique(codes[:-1] * len(number) + codes[1:], return_inverse=True)[1]
        _, which, counts = np.unique(pairs[:-1] * len(number) + codes[2:], return_inverse=True, return_counts=True)
        again = counts[which] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift:n - 2 + shift] |= again
        return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def short(t: Text) -> bool:
    return t.n_words < 50


def repetitive(t: Text) -> bool:
    return 100 * t.n_repeat_words > 50 * t.n_words


BASE = (Rule("short", short), Rule("repetitive", repetitive))
#: The whole cascade: the two base rules, and symbols, line repeats and word lengths that prose does not have.
RULES = BASE + (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("dup_lines", lambda t: 10 * t.n_dup_lines > 6 * len(t.lines)),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 14 * t.n_words),
)
SAMPLE_ROWS = 512  # a bound on what the driver holds for measuring


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text",
            sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, share rejected, seconds a text) on at most `sample_rows` rows, every rule on every one of them.

    The sample is what the first partitions have of a hash class of the ids; only as many partitions are read as it takes.
    """
    df = X.pick(docs, id_col, text_col)
    sample = [r.text.encode() for r in df.where(F.pmod(F.xxhash64("id"), F.lit(3)) == 0).select("text").take(sample_rows)]
    found = []
    for rule in rules:
        no, start = 0, time.perf_counter()
        for raw in sample:
            no += rule.rejects(Text(raw))
        found.append((rule.name, no / max(len(sample), 1), (time.perf_counter() - start) / max(len(sample), 1)))
    return found


def order(rules: tuple[Rule, ...], measured: list[tuple[str, float, float]]) -> tuple[Rule, ...]:
    """Rules in falling order of rejections per second; equal ones keep their order."""
    worth = {name: share / max(cost, 1e-9) for name, share, cost in measured}
    return tuple(sorted(rules, key=lambda rule: -worth[rule.name]))


def rejected_by(t: Text, cascade: tuple[Rule, ...]) -> str | None:
    """The first rule of the cascade that rejects the text."""
    return next((rule.name for rule in cascade if rule.rejects(t)), None)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base features and verdict of every text: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    cascade = order(rules, measure(docs, rules, id_col=id_col, text_col=text_col, sample_rows=sample_rows))

    def run(found: Iterable[tuple]) -> Iterator[tuple]:
        for key, raw in found:
            t = Text(raw)
            failed = any(rule.rejects(t) for rule in BASE)
            yield (key, t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed,
                   not failed and rejected_by(t, cascade) is None)

    df = X.pick(docs, id_col, text_col)
    kind, arrow = X.id_type(df)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return X.map_rows(
        df, run, ["id", "text"], f"id {kind}, {', '.join(f'{c} long' for c in counts)}, base_failed boolean, kept boolean",
        pa.schema([("id", arrow), *[(c, pa.int64()) for c in counts], ("base_failed", pa.bool_()), ("kept", pa.bool_())]))


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text",
                     sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with all their columns; later rules see only what earlier ones let through."""
    cascade = order(rules, measure(docs, rules, id_col=id_col, text_col=text_col, sample_rows=sample_rows))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([rejected_by(Text(raw or b""), cascade) is None for raw in X.raw(batch.column(place))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Periodic runs of words, by recompression.

The texts of a block lie side by side as word numbers, each followed by a mark of its own. Recompression writes that
sequence again and again, shorter each time: block compression makes one symbol of a stretch of equal symbols, pair
compression one symbol of every neighbouring pair whose first symbol falls into one half of the alphabet and whose second
into the other. Equal stretches are written alike up to a symbol at either end, so the levels are a
run-length grammar in which the longest common extension of two places is found by climbing while both stand at the
edge of a symbol and coming down where symbols differ, a fixed number of steps a level; all queries climb together.

A run with period q and at least four periods has a stretch of 3q places equal to those q further on, so a grid
of every 3q-th place meets it: n/3q candidates for each q, n log n in all (a harmonic sum). A candidate whose
place and two places around it differ from those q further on cannot be in such a run; the others are extended both
ways by the grammar, which gives start, length and period exactly. Of periods with one interval the smallest is kept.

Defined cases: null, empty and blank texts have no words and no runs (nulls, digests of empty strings); a text of any length is
one sequence, words are numbered as it is cut in slices; repeated ids and rows each keep their row; ties of the strongest run
go to the smaller start, then period; a null id counts as the empty string where the id decides; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyledger.llm import text as X

BLOCK_WORDS = 1 << 18  # texts are taken together up to about so many words; a longer one is a block of its own
SLICE = 1 << 20
BLANK = re.compile(rb"[ \t-\r]")


def number_words(raw: bytes, known: dict[bytes, int]) -> np.ndarray:
    """Numbers of a text's words; `known` gains the new ones. Cut in slices, so only distinct words are held as such."""
    parts, at = [], 0
    while at < len(raw):
        cut = BLANK.search(raw, at + SLICE) if len(raw) - at > SLICE else None
        end = cut.start() if cut else len(raw)
        parts.append(np.array([known.setdefault(w, len(known)) for w in raw[at:end].split()], np.int64))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


# ---------------------------------------------------------------- the grammar


class Level:
    """One writing of the sequence, and where the symbols of the next one begin."""

    def __init__(self, symbols: np.ndarray, edge: np.ndarray, blocks: bool):
        self.symbols, self.edge, self.blocks = symbols, edge, blocks  # the end of the sequence is an edge, too
        self.up = np.cumsum(edge) - 1       # the next level's symbol that a place belongs to
        self.down = np.flatnonzero(edge)    # the place where each of the next level's symbols begins, and the end


def _names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal pairs of numbers get equal names, and only they."""
    return np.unique(a * (int(b.max()) + 2) + b + 1, return_inverse=True)[1]


def _second(symbols: np.ndarray, turn: int) -> np.ndarray:
    """Whether a symbol is in the second half of the alphabet this turn."""
    x = (symbols + turn * 0x632BE5AB + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)) & np.uint64(1) == 1


def recompress(sequence: np.ndarray) -> list[Level]:
    """The levels below a single symbol, by turns of block and pair compression."""
    levels, now, turn = [], sequence, 0
    while len(now) > 1:
        edge = np.ones(len(now) + 1, bool)
        blocks = turn % 2 == 0
        if blocks:
            edge[1:-1] = now[1:] != now[:-1]
        else:
            second = _second(now, turn)
            edge[1:-1] = second[:-1] | ~second[1:]
        turn += 1
        if edge.all():
            continue  # nothing to compress: this level would be the next one as well
        level = Level(now, edge, blocks)
        levels.append(level)
        starts, sizes = level.down[:-1], np.diff(level.down)
        now = _names(now[starts], sizes if blocks else np.where(sizes == 2, now[np.minimum(starts + 1, len(now) - 1)], -1))
    return levels


Queries = tuple[np.ndarray, np.ndarray, np.ndarray]  # number of the query and its two places


def extend(levels: list[Level], i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """How many symbols from place i on agree with those from place j > i on (step 1), or before i with before j (step -1)."""
    waiting: list[Queries] = []
    now: Queries = (np.arange(len(i)), i, j)
    for level in levels:
        ready, stuck = [], []
        while len(now[0]):
            at = level.edge[now[1]] & level.edge[now[2]]
            ready.append(_those(now, at))
            now, stopped = _advance(level, _those(now, ~at), step)
            stuck.append(stopped)
        waiting.append(_joined(stuck))
        query, a, b = _joined(ready)
        now = query, level.up[a], level.up[b]
    # What has climbed above all levels stands at the two ends of the one symbol there.
    for level, late in zip(reversed(levels), reversed(waiting)):
        query, a, b = now
        now = _joined([(query, level.down[a], level.down[b]), late])
        done = []
        while len(now[0]):
            now, stopped = _advance(level, now, step)
            done.append(stopped)
        now = _joined(done)
    found = np.empty(len(i), np.int64)
    found[now[0]] = np.abs(now[1] - i[now[0]])
    return found


def _those(q: Queries, keep: np.ndarray) -> Queries:
    return q[0][keep], q[1][keep], q[2][keep]


def _joined(parts: list[Queries]) -> Queries:
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*parts))


def _advance(level: Level, q: Queries, step: int) -> tuple[Queries, Queries]:
    """Queries moved over a symbol that agrees (over all that is left of a stretch in a block level), and those that stop."""
    _, a, b = q
    back = int(step < 0)
    inside = a > 0 if back else b < len(level.symbols)
    x, y = np.where(inside, a - back, 0), np.where(inside, b - back, 0)
    same = inside & (level.symbols[x] == level.symbols[y])
    query, a, b = _those(q, same)
    if not level.blocks:
        return (query, a + step, b + step), _those(q, ~same)
    x, y = level.up[x[same]], level.up[y[same]]
    far = np.minimum(a - level.down[x], b - level.down[y]) if back else np.minimum(level.down[x + 1] - a, level.down[y + 1] - b)
    return (query, a + step * far, b + step * far), _those(q, ~same)


# ---------------------------------------------------------------- candidates and runs


def candidates(sequence: np.ndarray, bounds: np.ndarray, lengths: np.ndarray, least: int, times: int) -> Queries:
    """(q, place, place + q) on the harmonic grids. Texts lie in falling order of length; `bounds` are their ends."""
    padded = np.concatenate([[-1, -2], sequence, [-3, -4]])
    widest = int(lengths[0]) // times if len(lengths) else 0
    periods = np.arange(1, widest + 1)
    # For a period only the texts long enough for it, which come first.
    texts = np.searchsorted(-lengths, -np.maximum(times * periods, least), "right")
    ends = np.where(texts > 0, bounds[np.maximum(texts, 1) - 1], 0)
    grid = (times - 1) * periods
    counts = np.maximum(-(-(ends - periods) // grid), 0)
    found, k = [], 0
    total = np.cumsum(counts)
    while k < len(periods):
        upto = max(int(np.searchsorted(total, (total[k - 1] if k else 0) + (1 << 20), "right")), k + 1)
        c = counts[k:upto]
        q = np.repeat(periods[k:upto], c)
        i = (np.arange(len(q)) - np.repeat(np.cumsum(c) - c, c)) * (times - 1) * q
        same = padded[i + 2] == padded[i + q + 2]
        q, i = q[same], i[same]
        if times >= 4:  # three places in a row agree in every stretch looked for
            agree = [padded[i + d] == padded[np.minimum(i + q + d, len(padded) - 1)] for d in (0, 1, 3, 4)]
            near = (agree[1] & (agree[0] | agree[2])) | (agree[2] & agree[3])
            q, i = q[near], i[near]
        found.append((q, i, i + q))
        k = upto
    return _joined(found)


def find(texts: list[np.ndarray], least: int = 6, times: int = 4) -> list[np.ndarray]:
    """Of each sequence of word numbers its runs (start, length, period) by start, then period.

    A run is at least `least` words and `times` (3 or more) periods long.
    """
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    order = sorted((k for k, t in enumerate(texts) if len(t) >= least), key=lambda k: -len(texts[k]))
    for again in (False, True):
        if not order:
            return out
        lengths = np.array([len(texts[k]) for k in order])
        bounds = np.cumsum(lengths + 1)
        mark = 1 + max(int(texts[k].max()) for k in order)
        sequence = np.concatenate([x for n, k in enumerate(order) for x in (texts[k], [mark + n])])
        period, i, j = candidates(sequence, bounds, lengths, least, times)
        if not again:  # texts without a candidate need no grammar
            order = [order[n] for n in np.unique(np.searchsorted(bounds, i, "right")).tolist()]
    levels = recompress(sequence)
    start = i - extend(levels, i, j, -1)
    length = i + extend(levels, i, j, 1) - start + period
    good = length >= np.maximum(least, times * period)
    start, length, period = start[good], length[good], period[good]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    first = np.ones(len(by), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    by = np.lexsort((period, start))
    runs = np.stack([start, length, period], 1)[by]
    text = np.searchsorted(bounds, runs[:, 0], "right")
    runs[:, 0] -= np.concatenate([[0], bounds])[text]
    cuts = np.searchsorted(text, np.arange(len(order) + 1))
    for n, k in enumerate(order):
        out[k] = runs[cuts[n]:cuts[n + 1]]
    return out


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: each run keeps its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length in periods; ties go to the smaller start, then period."""
    best = None
    for s, n, p in runs.tolist():
        if best is None or n * best[2] > best[1] * p:
            best = s, n, p
    return best


Rewrite = Callable[[object, np.ndarray], np.ndarray]


def _scan(found: Iterable[tuple], rewrite: Rewrite | None, least: int, times: int) -> Iterator[tuple]:
    """(id, word numbers, words, runs) of every text, in blocks."""
    held, known, size = [], {}, 0
    for key, raw in found:
        numbers = number_words(raw, known)
        held.append((key, rewrite(key, numbers) if rewrite else numbers))
        size += len(numbers)
        if size >= BLOCK_WORDS:
            yield from _block(held, known, least, times)
            held, known, size = [], {}, 0
    yield from _block(held, known, least, times)


def _block(held: list[tuple], known: dict[bytes, int], least: int, times: int) -> Iterator[tuple]:
    words = list(known)
    for (key, numbers), runs in zip(held, find([t for _, t in held], least, times)):
        yield key, numbers, words, runs


def collapse(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """id, runs (start, length, period) and the text with each run's repeats left out, its words joined by blanks."""
    df = X.pick(docs, id_col, text_col)
    kind, arrow = X.id_type(df)

    def run(found: Iterable[tuple]) -> Iterator[tuple]:
        for key, numbers, words, runs in _scan(found, None, least, times):
            yield key, [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()], b" ".join(
                [words[k] for k in numbers[kept(len(numbers), runs)].tolist()]).decode()
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    return X.map_rows(df, run, ["id", "text"], f"id {kind}, runs array<struct<start: long, length: long, period: long>>, text string",
                      pa.schema([("id", arrow), ("runs", pa.list_(one)), ("text", pa.string())]), 256)


def report(docs: DataFrame, *, rewrite: Rewrite | None = None, id_col: str = "doc_id", text_col: str = "text", least: int = 6,
           times: int = 4) -> DataFrame:
    """id, number of runs, the strongest one, and digests of all runs and of the collapsed text; `rewrite` may change a text's words first."""
    df = X.pick(docs, id_col, text_col)
    kind, arrow = X.id_type(df)

    def run(found: Iterable[tuple]) -> Iterator[tuple]:
        for key, numbers, words, runs in _scan(found, rewrite, least, times):
            best = strongest(runs)
            listed = "".join([f"{s},{n},{p}\n" for s, n, p in runs.tolist()])
            left = numbers[kept(len(numbers), runs)]
            text = hashlib.sha256()
            for k in range(0, len(left), SLICE):
                text.update((b" " if k else b"") + b" ".join([words[w] for w in left[k:k + SLICE].tolist()]))
            yield (key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), text.hexdigest())
    names = ["n_runs", "start", "length", "period", "exponent_milli"]
    return X.map_rows(df, run, ["id", "text"], f"id {kind}, {', '.join(f'{n} long' for n in names)}, runs_sha256 string, collapsed_sha256 string",
                      pa.schema([("id", arrow), *[(n, pa.int64()) for n in names], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]), 1024)

"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edit distance.

Texts are sequences of lower-cased words without punctuation. Around every occurrence of one of an
item's anchors (its rarest words, at more places than edits are allowed, so one is always left) stands a window of the item's size. The CGK walk reads a window with a pointer that moves
on or stays by a random function of the step and the word it stands on, and writes the words it sees: two sequences k edits
apart fall back into step after each edit, so their embeddings agree in most places. Each LSH repetition samples some
places of one walk as a key; a window and an item that share a key in any repetition are a candidate pair, and a
semi-global edit distance over the window and its surroundings decides. Windows start at anchors because a shift is an edit too.

Items go to tasks in blocks of bounded size, each block against all documents, so nothing grows with the documents or unchecked
with the benchmark. A task holds one batch of documents.

Defined cases: null and empty texts match nothing; null or empty items are never found; items of fewer than five
words have to match exactly; repeated items and repeated documents give rows of their own; an empty table gives an empty result;
other columns are ignored by `matches` and passed on by `clean`.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import text as X

MAX_EDITS = 0.2  # share of the item's words
RECALL = 0.98
AGREEMENT = 0.35  # places of two embeddings that agree in the less lucky pairs at the most edits
SAMPLED = 3  # places in a key
WALKS = 12
ANCHORS = 5  # words at least; more where more edits are allowed
BLOCK_BYTES = 8 << 20

_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_CUT = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PAD = np.uint64(0)


def tokens(raw: bytes) -> list[bytes]:
    return raw.decode("utf-8", "replace").lower().encode().translate(_CUT).split()


def repetitions(recall: float = RECALL, agreement: float = AGREEMENT, sampled: int = SAMPLED) -> int:
    """Keys needed so that a pair whose embeddings agree in such a share of places meets in one of them."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement ** sampled))


def numbers(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 7) | 1 for w in words), np.uint64, len(words))


def embed(windows: np.ndarray, walk: int) -> np.ndarray:
    """CGK embeddings (three times as long) of the rows of a matrix of word numbers."""
    count, n = windows.shape
    padded = np.concatenate([windows, np.full((count, 1), _PAD)], axis=1)
    flat, base = padded.ravel(), np.arange(count) * (n + 1)
    at = np.zeros(count, np.int64)
    out = np.empty((3 * n, count), np.uint64)
    for step in range(3 * n):
        seen = flat[base + at]
        out[step] = seen
        coin = (seen ^ np.uint64(((walk + 1) << 32) + step)) * _ODD
        at = np.minimum(at + ((coin ^ (coin >> np.uint64(29))) * _ODD >> np.uint64(63)).astype(np.int64), n)
    return out


def keys(windows: np.ndarray, count: int, walks: int = WALKS, sampled: int = SAMPLED) -> np.ndarray:
    """`count` keys of each row: places sampled from each of the walks in turn."""
    n = windows.shape[1]
    found = np.empty((count, len(windows)), np.uint64)
    for walk in range(min(walks, count)):
        path = embed(windows, walk)
        for r in range(walk, count, walks):
            # Places past the end of the walks hold no words; the first two thirds are always reached.
            places = np.random.default_rng([n, r]).choice(2 * n, size=min(sampled, 2 * n), replace=False)
            key = np.full(len(windows), r + 1, np.uint64)
            for place in places:
                key = (key ^ path[place]) * _ODD
                key ^= key >> np.uint64(31)
            found[r] = key
    return found


def edit_distance(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Least edits that turn the item into some part of the passage, and where that part ends."""
    steps = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    for k, word in enumerate(item):
        down = row + 1
        down[1:] = np.minimum(down[1:], row[:-1] + (passage != word))
        row = np.minimum.accumulate(down - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


class Index:
    """Anchors and LSH tables of one block of items."""

    def __init__(self, items: list[tuple], max_edits: float, recall: float):
        self.count = repetitions(recall)
        self.items = [(key, numbers(ws)) for key, ws in items]
        self.edits = [int(max_edits * len(ws)) for _, ws in items]
        self.anchors: dict[bytes, set[tuple[int, int]]] = defaultdict(set)  # word: (size, place in the item)
        sizes: dict[int, list[int]] = defaultdict(list)
        common = Counter(w for _, ws in items for w in ws)
        for k, (_, ws) in enumerate(items):
            sizes[len(ws)].append(k)
            places: dict[bytes, list[int]] = defaultdict(list)
            for place, w in enumerate(ws):
                places[w].append(place)
            # An edit takes away one place of the item at most: of more places than edits, one is left as it was.
            held = 0
            for rank, w in enumerate(sorted(places, key=lambda w: (common[w], -len(w), w))):
                if rank >= ANCHORS and held > self.edits[k]:
                    break
                self.anchors[w].update((len(ws), place) for place in places[w])
                held += len(places[w])
        self.tables: dict[int, dict[tuple[int, int], list[int]]] = {}
        for n, own in sizes.items():
            table = self.tables[n] = defaultdict(list)
            for r, row in enumerate(keys(np.stack([self.items[k][1] for k in own]), self.count).tolist()):
                for k, key in zip(own, row):
                    table[r, key].append(k)

    def find(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word of the window, edits): the closest place of each item in each text."""
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        held: dict[int, np.ndarray] = {}
        anchors = self.anchors
        for t, raw in enumerate(texts):
            ws = tokens(raw)
            met = [k for k, w in enumerate(ws) if w in anchors]
            if met:
                spots = {(n, max(0, k - place)) for k in met for n, place in anchors[ws[k]]}
                held[t] = numbers(ws)
                for n, start in spots:
                    windows[n].append((t, start))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for n, spots in windows.items():
            spots.sort()
            for k in range(0, len(spots), 2048):
                part = spots[k:k + 2048]
                matrix = np.full((len(part), n), _PAD)
                for row, (t, start) in enumerate(part):
                    cut = held[t][start:start + n]
                    matrix[row, :len(cut)] = cut
                table, pairs = self.tables[n], set()
                for r, row in enumerate(keys(matrix, self.count).tolist()):
                    for w, key in enumerate(row):
                        if (r, key) in table:
                            pairs.update((w, i) for i in table[r, key])
                for w, i in pairs:
                    t, start = part[w]
                    allowed = self.edits[i]
                    first = max(0, start - allowed)
                    edits, _ = edit_distance(self.items[i][1], held[t][first:start + n + allowed])
                    if edits <= allowed:
                        best[t, i] = min(best.get((t, i), (edits, start)), (edits, start))
        for (t, i), (edits, start) in sorted(best.items()):
            yield t, i, start, edits


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """Items as words, in lists of about `block_bytes` of text, dealt by a hash."""
    items = X.pick(benchmark, item_col, text_col)
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-size // block_bytes))
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).collect()
        yield [(r.id, ws) for r in part if (ws := tokens(r.text.encode()))]


_made: dict[str, Index] = {}


def _shared(spark, items: list[tuple], max_edits: float, recall: float):
    """The items at every executor; a Python worker makes the index from them once, however many tasks it runs."""
    sent, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def index() -> Index:
        return kept_index(name, lambda: Index(sent.value, max_edits, recall))
    return index


def kept_index(name: str, make: Callable[[], Index]) -> Index:
    """One index a worker; that of another block or query takes its place."""
    if name not in _made:
        _made.clear()
        _made[name] = make()
    return _made[name]


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text", max_edits: float = MAX_EDITS, recall: float = RECALL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, item, at (first word of the window), n_words (of the item), edits: one row for each item found in a document."""
    df = X.pick(docs, id_col, text_col)
    kind, arrow = X.id_type(df)
    item_kind, item_arrow = X.id_type(X.pick(benchmark, item_col, item_text_col))
    schema = pa.schema([("id", arrow), ("item", item_arrow), ("at", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64())])
    found = None
    for items in blocks(benchmark, item_col, item_text_col, block_bytes):
        index = _shared(df.sparkSession, items, max_edits, recall)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            def rows():
                for batch in batches:
                    ids = batch.column(0).to_pylist()
                    for t, i, at, edits in index().find(X.raw(batch.column(1))):
                        key, ws = index().items[i]
                        yield ids[t], key, at, len(ws), edits
            return X.batched(rows(), schema)

        part = df.mapInArrow(run, f"id {kind}, item {item_kind}, at long, n_words long, edits long")
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
          max_edits: float = MAX_EDITS, recall: float = RECALL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no item is found, with all their columns; no shuffle."""
    place, out = docs.columns.index(text_col), docs
    for items in blocks(benchmark, item_col, item_text_col, block_bytes):
        index = _shared(docs.sparkSession, items, max_edits, recall)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = {t for t, *_ in index().find([raw or b"" for raw in X.raw(batch.column(place))])}
                yield batch.filter(pa.array([t not in bad for t in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out

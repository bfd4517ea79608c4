"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word goes in as the sum of its own vector and the mean vector of its character trigrams, both from hashed tables. Windows of WINDOW
words, one every STRIDE, overlap and cover the whole text; each is read in both directions, pooled by attention and
given a logit. A text's score is that of its worst window. Training knows only which texts are toxic, so a text's
gradient goes to its windows by the softmax of their logits (multiple-instance learning).

The model is fitted on at most MAX_ROWS labelled rows of each class, the first in the order of a hash of the id; it has a
fixed size, and scoring runs over all texts where they lie, a batch at a time.

Defined cases: null and empty texts are scored as one window without words; ids without a label, null labels and repeated labels
are fine (a label counts as toxic only if it is 1); repeated ids are scored row by row; other columns are ignored; with labels of one class
or none the score is the same for all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm import text as X

WINDOW = 24
STRIDE = 16
WIDTH = 12  # of word vectors
HIDDEN = 8  # each way
WORD_ROWS = 8192
GRAM_ROWS = 8192
MAX_ROWS = 1000  # labelled rows of each class that training sees
WINDOWS_SEEN = 150_000  # in training, over all passes
SHARPNESS = 3.0  # of the softmax that shares a text's gradient among its windows
_TOGETHER = 2048  # windows computed at once

Params = dict[str, np.ndarray]


# ---------------------------------------------------------------- inputs


class Inputs:
    """Texts as windows over a list of distinct words, and the words' rows in the hashed tables."""

    def __init__(self, texts: list[bytes]):
        number: dict[bytes, int] = {b"": 0}
        coded = [np.fromiter((number.setdefault(w, len(number)) for w in raw.lower().split()), np.int64) for raw in texts]
        spans = [range(0, max(len(c) - (WINDOW - STRIDE), 1), STRIDE) for c in coded]
        self.of_text = np.repeat(np.arange(len(texts)), [len(s) for s in spans])
        self.windows = np.zeros((len(self.of_text), WINDOW), np.int64)  # 0 is no word
        row = 0
        for c, starts in zip(coded, spans):
            flat = np.zeros(starts[-1] + WINDOW, np.int64)
            flat[:min(len(c), len(flat))] = c[:len(flat)]
            view = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[::STRIDE]
            self.windows[row:row + len(starts)] = view[:len(starts)]
            row += len(starts)
        words = list(number)
        self.word_rows = np.fromiter((xxhash.xxh32_intdigest(w) % WORD_ROWS for w in words), np.int64, len(words))
        # Trigrams of "<word>" over one buffer of all words; those that reach into the next word are left out.
        buffer = np.frombuffer(b"<" + b"><".join(words) + b">\0\0", np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        ends = np.cumsum(sizes)
        grams = ((buffer[:-2] << 16) | (buffer[1:-1] << 8) | buffer[2:]) * 0x9E3779B1
        self.gram_rows = ((grams >> 15) & 0xFFFFFFFF) % GRAM_ROWS
        self.gram_word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(self.gram_word))
        whole = place < ends[self.gram_word] - 2
        self.gram_rows, self.gram_word = self.gram_rows[whole], self.gram_word[whole]
        self.gram_count = np.maximum(np.bincount(self.gram_word, minlength=len(words)), 1)[:, None].astype(np.float32)


def vectors(p: Params, x: Inputs) -> np.ndarray:
    """Input vector of each distinct word; zero for no word."""
    out = p["words"][x.word_rows]
    grams = p["grams"][x.gram_rows]
    starts = np.flatnonzero(np.diff(x.gram_word, prepend=-1))
    out[x.gram_word[starts]] += np.add.reduceat(grams, starts, axis=0) / x.gram_count[x.gram_word[starts]] if len(starts) else 0
    out[0] = 0
    return out


# ---------------------------------------------------------------- network


def fresh(seed: int = 5) -> Params:
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    p = {"words": draw(0.1, WORD_ROWS, WIDTH), "grams": draw(0.1, GRAM_ROWS, WIDTH)}
    for way in "fb":
        p |= {f"in_{way}": draw(WIDTH ** -0.5, WIDTH, 3 * HIDDEN), f"loop_{way}": draw(HIDDEN ** -0.5, HIDDEN, 3 * HIDDEN), f"bias_{way}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"look": draw(0.3, 2 * HIDDEN), "out": draw(0.3, 2 * HIDDEN), "shift": np.zeros(1, np.float32)}


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * v) + 0.5


def _read(p: Params, way: str, seen: np.ndarray, keep: list | None) -> np.ndarray:
    """States after each word, (steps, windows, HIDDEN). seen: gate inputs, (steps, windows, 3 HIDDEN), in reading order."""
    H = HIDDEN
    loop = p[f"loop_{way}"]
    states = np.empty((*seen.shape[:2], H), np.float32)
    h = np.zeros((seen.shape[1], H), np.float32)
    for t in range(len(seen)):
        turn = h @ loop
        gates = _sigmoid(seen[t, :, :2 * H] + turn[:, :2 * H])
        z, r = gates[:, :H], gates[:, H:]
        fill = np.tanh(seen[t, :, 2 * H:] + r * turn[:, 2 * H:])
        if keep is not None:
            keep.append((h, z, r, fill, turn[:, 2 * H:]))
        h = fill + z * (h - fill)
        states[t] = h
    return states


def forward(p: Params, gates: dict[str, np.ndarray], windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of each window. gates: of each distinct word, by direction."""
    order = np.ascontiguousarray(windows.T)
    kept = {"f": [] if keep is not None else None, "b": [] if keep is not None else None}
    ahead = _read(p, "f", gates["f"][order], kept["f"])
    back = _read(p, "b", gates["b"][order[::-1]], kept["b"])[::-1]
    both = np.concatenate([ahead, back], axis=2)
    real = order > 0
    real[0] |= ~real.any(axis=0)
    weight = both @ p["look"]
    weight = np.where(real, weight, -np.inf)
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", weight, both)
    if keep is not None:
        keep.update(both=both, weight=weight, pooled=pooled, steps=kept, order=order)
    return pooled @ p["out"] + p["shift"][0]


def backward(p: Params, keep: dict, grad: np.ndarray, gates: dict[str, np.ndarray]) -> tuple[Params, dict[str, np.ndarray]]:
    """Gradients of the parameters above the gate inputs, and of the gate inputs of each distinct word."""
    H, both, weight, pooled, order = HIDDEN, keep["both"], keep["weight"], keep["pooled"], keep["order"]
    g: Params = {"out": pooled.T @ grad, "shift": grad.sum(keepdims=True)}
    d_pooled = grad[:, None] * p["out"]
    d_weight = np.einsum("bh,tbh->tb", d_pooled, both)
    d_look = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["look"] = np.einsum("tb,tbh->h", d_look, both)
    d_both = weight[:, :, None] * d_pooled + d_look[:, :, None] * p["look"]
    d_gates = {}
    for way, own in (("f", d_both[:, :, :H]), ("b", d_both[::-1, :, H:])):
        loop, d_loop = p[f"loop_{way}"], np.zeros_like(p[f"loop_{way}"])
        d_seen = np.empty((*own.shape[:2], 3 * H), np.float32)
        d_h = np.zeros(own.shape[1:], np.float32)
        for t in range(len(own) - 1, -1, -1):
            h, z, r, fill, turned = keep["steps"][way][t]
            d_h = d_h + own[t]
            d_fill = d_h * (1 - z) * (1 - fill * fill)
            d_z = d_h * (h - fill) * z * (1 - z)
            d_r = d_fill * turned * r * (1 - r)
            d_turn = np.concatenate([d_z, d_r, d_fill * r], axis=1)
            d_seen[t] = np.concatenate([d_z, d_r, d_fill], axis=1)
            d_loop += h.T @ d_turn
            d_h = d_h * z + d_turn @ loop.T
        g[f"loop_{way}"] = d_loop
        flat = (order if way == "f" else order[::-1]).ravel()
        rows = d_seen.reshape(-1, 3 * H)
        d_gates[way] = np.stack([np.bincount(flat, rows[:, k], len(gates[way])) for k in range(3 * H)], axis=1).astype(np.float32)
    return g, d_gates


def _gates(p: Params, given: np.ndarray) -> dict[str, np.ndarray]:
    return {way: given @ p[f"in_{way}"] + p[f"bias_{way}"] for way in "fb"}


def text_logits(p: Params, texts: list[bytes]) -> np.ndarray:
    """The largest window logit of each text."""
    if not texts:
        return np.zeros(0)
    x = Inputs(texts)
    gates = _gates(p, vectors(p, x))
    logits = np.concatenate([forward(p, gates, x.windows[k:k + _TOGETHER]) for k in range(0, len(x.windows), _TOGETHER)])
    return np.maximum.reduceat(logits, np.flatnonzero(np.diff(x.of_text, prepend=-1)))


# ---------------------------------------------------------------- training


def gradient(p: Params, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> tuple[float, Params]:
    """Loss and gradient of one group of texts; window weights are held constant."""
    x = Inputs(texts)
    given = vectors(p, x)
    gates = _gates(p, given)
    keep: dict = {}
    logits = forward(p, gates, x.windows, keep)
    starts = np.flatnonzero(np.diff(x.of_text, prepend=-1))
    top = np.maximum.reduceat(logits, starts)[x.of_text]
    share = np.exp(SHARPNESS * (logits - top))
    share /= np.add.reduceat(share, starts)[x.of_text]
    whole = np.add.reduceat(share * logits, starts)
    chance = _sigmoid(whole)
    loss = -np.mean(weights * np.where(labels == 1, np.log(chance + 1e-9), np.log(1 - chance + 1e-9)))
    d_text = weights * (chance - labels) / len(texts)
    g, d_gates = backward(p, keep, (share * d_text[x.of_text]).astype(np.float32), gates)
    d_given = np.zeros_like(given)
    for way in "fb":
        g[f"in_{way}"], g[f"bias_{way}"] = given.T @ d_gates[way], d_gates[way].sum(axis=0)
        d_given += d_gates[way] @ p[f"in_{way}"].T
    d_given[0] = 0
    each = (d_given / x.gram_count)[x.gram_word]
    add = lambda rows, values, n: np.stack([np.bincount(rows, values[:, k], n) for k in range(WIDTH)], axis=1).astype(np.float32)
    g["words"], g["grams"] = add(x.word_rows, d_given, WORD_ROWS), add(x.gram_rows, each, GRAM_ROWS)
    return float(loss), g


def fit(texts: list[bytes], labels: list[int], *, rate: float = 0.01, windows_seen: int = WINDOWS_SEEN, seed: int = 5) -> Params:
    """Adam over groups of about 1,024 windows until so many windows have been seen, in at least three passes. Classes weigh the same in total."""
    p = fresh(seed)
    texts, target = [*texts, b""], np.array([*labels, 0])
    if len(set(labels)) < 2:
        p["out"][:] = 0
        p["shift"][:] = 3.0 if labels and labels[0] == 1 else -3.0
        return p
    weigh = np.where(target == 1, len(target) / (2 * target.sum()), len(target) / (2 * (target == 0).sum()))
    size = np.array([max(1, -(-len(t.split()) // STRIDE)) for t in texts])
    rng = np.random.default_rng(seed)
    first, second, step, seen, passes = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0, 0, 0
    while seen < windows_seen or passes < 3:
        order = rng.permutation(len(texts))
        groups = np.split(order, np.flatnonzero(np.diff(np.cumsum(size[order]) // 1024)) + 1)
        for own in groups:
            _, g = gradient(p, [texts[k] for k in own], target[own], weigh[own])
            step += 1
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                p[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
            seen += int(size[own].sum())
        passes += 1
    return p


def sample(docs: DataFrame, labels: DataFrame, training: Column, *, id_col: str, text_col: str, label_col: str, max_rows: int) -> tuple[list[bytes], list[int]]:
    """Texts and labels of at most `max_rows` training rows of each class. `training` is a condition on the id column."""
    own = labels.where(training).select(F.col(id_col).alias("id"), F.coalesce((F.col(label_col) == 1).cast("int"), F.lit(0)).alias("label"))
    order = F.xxhash64("id")
    picked = None
    for k in (0, 1):
        part = own.where(F.col("label") == k).orderBy(order, "id").limit(max_rows)
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 x max_rows ids: a proven bound.
    rows = X.pick(docs, id_col, text_col).join(F.broadcast(picked), "id").collect()
    rows.sort(key=lambda r: (str(r.id), r.text))
    return [r.text.encode() for r in rows], [r.label for r in rows]


def train(docs: DataFrame, labels: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = MAX_ROWS) -> Params:
    return fit(*sample(docs, labels, training, id_col=id_col, text_col=text_col, label_col=label_col, max_rows=max_rows))


def score(docs: DataFrame, params: Params, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) and predicted (1 from 0.5 on) of every text."""
    df = X.pick(docs, id_col, text_col)
    kind, arrow = X.id_type(df)
    schema = pa.schema([("id", arrow), ("score", pa.float64()), ("predicted", pa.int32())])
    sent = df.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), X.raw(batch.column(1))
            for k in range(0, len(texts), 1024):
                chance = _sigmoid(text_logits(sent.value, texts[k:k + 1024]).astype(np.float64))
                yield pa.RecordBatch.from_arrays([ids[k:k + 1024], pa.array(chance), pa.array((chance >= 0.5).astype(np.int32))], schema=schema)

    return df.mapInArrow(run, f"id {kind}, score double, predicted int")

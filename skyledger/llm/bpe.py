"""Byte-pair encoding and decoding over an index of pair occurrences.

The new words of a block of texts lie side by side in one linked array of symbols. The index maps each pair that has
a rank to all its positions in that array. Active ranks are taken in ascending order; a rank merges its pair
everywhere at once, which takes the neighbouring pairs' positions out of their lists and enters the new pairs'
positions into theirs. A merged symbol's own pairs always rank behind the merge that made it (checked when the
vocabulary is read), so the order within a word is that of merging one pair at a time, leftmost first.

Vocabulary, merges, special strings, the text normaliser and the cut into pieces come from a file of the tokenizers
library; merging and decoding are done here. With `by_word` (right for vocabularies whose pieces never hold
blanks) a text is cut at blanks first and each word is encoded once and remembered, in a memory of bounded bytes.

Defined cases: null and empty texts have no tokens (the digest of the empty string, decoded to the empty string); texts of
blanks alone likewise; a text of any length is encoded whole and digested in slices; repeated ids and rows each keep
their row; null ids stay null; special strings inside a text become their single id, as the library has it by
default; ties between equal pairs go to the leftmost; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from skyledger.llm import text as X

BLOCK_BYTES = 8 << 20     # texts are taken in blocks of about this size; one longer text is a block of its own
MEMORY_BYTES = 200 << 20  # words remembered by one Python worker, counted as their bytes and their ids' bytes and 150 a word
GONE = -2                 # a symbol that was merged into its left neighbour
EDGE = -1                 # between two pieces


class Merger:
    """Merges of a vocabulary, applied to many pieces at once."""

    def __init__(self, model: dict):
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        if model.get("continuing_subword_prefix") or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("prefixes, dropout, byte fallback and whole-word matches are not supported")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.width = max(self.vocab.values()) + 1
        last_made = np.full(self.width, -1)
        np.maximum.at(last_made, self.made, np.arange(len(pairs)))
        if (np.maximum(last_made[self.left], last_made[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("a pair ranks before the merge that makes one of its symbols")
        keys = self.left * self.width + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        # First symbols of the characters a piece may hold, inside a piece and at its end.
        letters = {c for c in self.vocab if len(c) == 1}
        self.inner = np.full(0x110000 if max(map(ord, letters)) >= 0x400 else 0x400, GONE - 1, np.int32)
        self.final = self.inner.copy()
        for c in letters:
            self.inner[ord(c)] = self.vocab[c]
            self.final[ord(c)] = self.vocab.get(c + suffix, GONE - 1)
        self.inner[0] = self.final[0] = EDGE

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none."""
        key = left * np.int64(self.width) + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.order[at], -1)

    def merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' ids one after another, and where each piece's ids end."""
        codes = np.frombuffer(("\0" + "\0".join(pieces) + "\0").encode("utf-32-le"), "<u4")
        symbols = self.inner[codes]
        last = np.flatnonzero(codes[1:] == 0)
        symbols[last] = self.final[codes[last]]
        if (symbols < GONE).any():
            raise ValueError("a piece holds a character that the vocabulary has not")
        n = len(symbols)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)

        index: dict[int, list[np.ndarray]] = {}
        found = self.ranks(symbols[:-1].astype(np.int64), symbols[1:].astype(np.int64))
        at = np.flatnonzero(found >= 0).astype(np.int32)
        active: list[int] = []
        self._enter(index, active, found[at], at)
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            places = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, c = int(self.left[rank]), int(self.right[rank]), int(self.made[rank])
            # Positions whose pair was broken by an earlier rank leave the list here.
            places = places[symbols[places] == a]
            places = places[symbols[after[places]] == b]
            if a == b and len(places) > 1:
                places = _apart(places, after)
            if not len(places):
                continue
            taken = after[places]
            ends = after[taken]
            symbols[places], symbols[taken] = c, GONE
            after[places], before[ends] = ends, places
            starts = before[places]
            merged = np.full(len(places), c, np.int64)
            found = np.concatenate([self.ranks(symbols[starts].astype(np.int64), merged), self.ranks(merged, symbols[ends].astype(np.int64))])
            keep = found >= 0
            self._enter(index, active, found[keep], np.concatenate([starts, places])[keep])
        ids = symbols[symbols != GONE]
        edges = np.flatnonzero(ids == EDGE)
        return ids[ids >= 0].astype("<u4"), (edges - np.arange(len(edges)))[1:]

    @staticmethod
    def _enter(index: dict[int, list[np.ndarray]], active: list[int], ranks: np.ndarray, places: np.ndarray) -> None:
        """Positions into the lists of their pairs; lists that are new become active."""
        if not len(ranks):
            return
        order = np.lexsort((places, ranks))
        ranks, places = ranks[order], places[order]
        fresh = np.concatenate([[True], (ranks[1:] != ranks[:-1]) | (places[1:] != places[:-1])])  # both ends may have merged
        ranks, places = ranks[fresh], places[fresh]
        cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cut.tolist()]
        for rank, s, e in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)]):
            held = index.get(rank)
            if held is None:
                index[rank] = [places[s:e]]
                heapq.heappush(active, rank)
            else:
                held.append(places[s:e])


def _apart(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of a chain of overlapping places of a pair of equal symbols every second one, from the left."""
    linked = np.concatenate([[False], after[places[:-1]] == places[1:]])
    heads = np.maximum.accumulate(np.where(linked, 0, np.arange(len(places))))
    return places[(np.arange(len(places)) - heads) % 2 == 0]


def _bounds(held: pa.LargeBinaryArray) -> np.ndarray:
    """Where each value begins in the array's bytes, and where the last ends."""
    raw = held.buffers()[1]
    return np.frombuffer(raw, np.int64)[held.offset:held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int64)


class Codec:
    """Ids of whole texts and texts of ids, by one vocabulary file."""

    def __init__(self, path: str, *, by_word: bool = True, memory_bytes: int = MEMORY_BYTES):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as held:
            spec = json.load(held)
        if spec["model"]["type"] != "BPE":
            raise ValueError("not a byte-pair vocabulary")
        library = Tokenizer.from_file(path)
        self.normalizer, self.cutter, self.decoder = library.normalizer, library.pre_tokenizer, library.decoder
        self.merger = Merger(spec["model"])
        added = {t["content"]: t for t in spec.get("added_tokens", [])}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added.values()):
            raise ValueError("only plain special strings are supported")
        self.special = {content: np.array([t["id"]], "<u4").tobytes() for content, t in added.items()}
        self.cut_special = re.compile("(" + "|".join(re.escape(c) for c in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.in_special = re.compile(self.cut_special.pattern.encode()) if added else None
        self.less_first = all(c.startswith("<") for c in added)
        size = max([self.merger.width - 1, *(t["id"] for t in added.values())]) + 1
        self.tokens = [""] * size
        for content, k in [*self.merger.vocab.items(), *((c, t["id"]) for c, t in added.items())]:
            self.tokens[k] = content
        self.raw = [t.encode() for t in self.tokens]
        #: Each token's number and text, with the blank behind it.
        self.decimal = pa.array([b"%d " % k for k in range(size)], pa.large_binary())
        self.spaced = pa.array([t + b" " for t in self.raw], pa.large_binary())
        self.by_word, self.memory_bytes = by_word, memory_bytes
        #: Words met lately, and those met before them that may be forgotten next.
        self.memory: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def _pieces(self, part: str) -> list[str]:
        if self.normalizer:
            part = self.normalizer.normalize_str(part)
        return [p for p, _ in self.cutter.pre_tokenize_str(part)] if self.cutter else [part] * bool(part)

    def _cut(self, parts: list[str]) -> tuple[list[str], np.ndarray]:
        """Pieces of all parts, and how many each has. Words are normalised and cut in one call for many, where that keeps them apart."""
        if self.by_word and len(parts) > 1:
            joined = " ".join(parts)
            joined = self.normalizer.normalize_str(joined) if self.normalizer else joined
            words = joined.split(" ")
            if len(words) == len(parts):
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                found = self.cutter.pre_tokenize_str(joined) if self.cutter else []
                owner = np.searchsorted(ends, np.fromiter((start for _, (start, _) in found), np.int64, len(found)), "right")
                return ([p for p, _ in found], np.bincount(owner, minlength=len(parts))) if self.cutter else (words, np.ones(len(words), np.int64))
        cut = [self._pieces(p) for p in parts]
        return [p for pieces in cut for p in pieces], np.array([len(pieces) for pieces in cut], np.int64)

    def _learn(self, raws: list[bytes]) -> list[bytes]:
        """Ids of words (or texts) not seen before, all through one index of pairs."""
        pieces: list[str] = []
        counts = np.zeros(len(raws), np.int64)
        odd: dict[int, list] = {}  # those with a special string: its id, or the number of a piece
        plain = list(range(len(raws)))
        if self.in_special:
            plain = [k for k in plain if b"<" not in raws[k] or not self.in_special.search(raws[k])] if self.less_first else [
                k for k in plain if not self.in_special.search(raws[k])]
        for k in range(0, len(plain), 512):
            some = plain[k:k + 512]
            found, counts[some] = self._cut([raws[j].decode("utf-8", "replace") for j in some])
            pieces += found
        for k in sorted(set(range(len(raws))) - set(plain)) if len(plain) < len(raws) else []:
            steps = odd[k] = []
            for part in self.cut_special.split(raws[k].decode("utf-8", "replace")):
                if part in self.special:
                    steps.append(self.special[part])
                elif part:
                    own = self._pieces(part)
                    steps += range(len(pieces), len(pieces) + len(own))
                    pieces += own
        if not pieces:
            return [b"".join(odd[k]) if k in odd else b"" for k in range(len(raws))]
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        ids, ends = self.merger.merge(coded.dictionary.to_pylist())
        known = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int64)), pa.py_buffer(ids)])
        each = known.take(coded.indices)
        bounds, data = _bounds(each), memoryview(each.buffers()[2] or b"")
        at = bounds[np.concatenate([[0], np.cumsum(counts)])].tolist()
        out = [bytes(data[a:z]) for a, z in zip(at, at[1:])]
        for k, steps in odd.items():
            out[k] = b"".join(s if isinstance(s, bytes) else bytes(data[bounds[s]:bounds[s + 1]]) for s in steps)
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. A word is looked up once for all texts."""
        if not self.by_word:
            own = list(set(texts))
            found = dict(zip(own, self._learn(own)))
            return [found[t] for t in texts]
        if not texts:
            return []
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        coded = pc.list_flatten(cut).view(pa.large_binary()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if self.held > self.memory_bytes // 2:
            self.older, self.memory, self.held = self.memory, {}, 0
        parts = list(map(self.memory.get, words))
        holes = [k for k, part in enumerate(parts) if part is None]
        if holes:
            unseen = []
            for k in holes:
                part = parts[k] = self.older.get(words[k])
                if part is None:
                    unseen.append(k)
            for k, part in zip(unseen, self._learn([words[k] for k in unseen]) if unseen else []):
                parts[k] = part
            self.memory.update((words[k], parts[k]) for k in holes)
            self.held += sum(len(words[k]) + len(parts[k]) for k in holes) + 150 * len(holes)
        # The ids of all words, end to end; a text's begin and end where its words do.
        ids = pa.array(parts, pa.large_binary()).take(coded.indices)
        at = _bounds(ids)[cut.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[a:z]) for a, z in zip(at, at[1:])]

    def decode(self, ids: bytes) -> bytes:
        """Text of ids, special strings included, as the library's decoder of the vocabulary has it."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.decoder is None:
            return b" ".join(map(self.raw.__getitem__, numbers))
        return self.decoder.decode(list(map(self.tokens.__getitem__, numbers))).encode()

    def digest(self, ids: bytes, step: int = 1 << 22) -> tuple[str, str]:
        """sha256 of the decimal ids joined by blanks, and of the decoded text."""
        numbers, text = hashlib.sha256(), hashlib.sha256()
        if self.decoder is not None:
            text.update(self.decode(ids))
        for k in range(0, len(ids), step):
            part = pa.array(np.frombuffer(ids[k:k + step], "<u4"))
            for digest, tokens in ((numbers, self.decimal), (text, self.spaced))[:2 if self.decoder is None else 1]:
                held = memoryview(tokens.take(part).buffers()[2])
                digest.update(held if k + step < len(ids) else held[:-1])
        return numbers.hexdigest(), text.hexdigest()


_codecs: dict[tuple[str, bool], Codec] = {}


def codec(path: str, by_word: bool = True) -> Codec:
    """One a Python worker; it outlives a task."""
    if (path, by_word) not in _codecs:
        _codecs[path, by_word] = Codec(path, by_word=by_word)
    return _codecs[path, by_word]


def _blocks(found: Iterable[tuple], limit: int) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in found:
        held.append(row)
        size += len(row[1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", by_word: bool = True) -> DataFrame:
    """id and ids (array of int) of every text."""
    df = X.pick(docs, id_col, text_col)
    kind, arrow = X.id_type(df)

    def run(found: Iterable[tuple]) -> Iterator[tuple]:
        for block in _blocks(found, BLOCK_BYTES):
            for (key, _), ids in zip(block, codec(tokenizer, by_word).encode([t for _, t in block])):
                yield key, np.frombuffer(ids, "<i4")
    return X.map_rows(df, run, ["id", "text"], f"id {kind}, ids array<int>", pa.schema([("id", arrow), ("ids", pa.list_(pa.int32()))]), 256)


def decode(encoded: DataFrame, *, tokenizer: str, by_word: bool = True) -> DataFrame:
    """id and text of every row of ids; null ids give an empty text."""
    df = encoded.select("id", "ids")
    kind, arrow = X.id_type(df)

    def run(found: Iterable[tuple]) -> Iterator[tuple]:
        for key, ids in found:
            yield key, codec(tokenizer, by_word).decode(np.array(ids if ids is not None else [], "<u4").tobytes()).decode()
    return X.map_rows(df, run, ["id", "ids"], f"id {kind}, text string", pa.schema([("id", arrow), ("text", pa.string())]), 256)


def round_trip(docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", by_word: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256: every text encoded, its ids decoded again, and both digested where they are."""
    df = X.pick(docs, id_col, text_col)
    kind, arrow = X.id_type(df)

    def run(found: Iterable[tuple]) -> Iterator[tuple]:
        own = codec(tokenizer, by_word)
        for block in _blocks(found, BLOCK_BYTES):
            for (key, _), ids in zip(block, own.encode([t for _, t in block])):
                yield key, len(ids) // 4, *own.digest(ids)
    return X.map_rows(df, run, ["id", "text"], f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", pa.schema(
        [("id", arrow), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]), 1024)

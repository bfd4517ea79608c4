"""Main text of pages through a suffix array of each host's pages.

The blocks of a host's pages are laid end to end as one stream of tokens. Near copies of a text count as one: pages whose article, or
longest block for how many pages have it, share at least half of their runs of MIN_RUN tokens. A suffix array of the stream, sorted by the
first tokens of every suffix, brings repeats together: a run of MIN_RUN or more tokens that begins alike on two distinct
texts is a repeat, so what copies share is none. Places in the page (paths of elements and classes) whose tokens are mostly
repeats are boilerplate places; runs there are removed and unique runs stay. Elsewhere a whole block goes that several
texts, and a tenth of the host's, have beside text of their own. Inside article and main elements, places of own texts, and of
fewer texts than that, are never boilerplate places, and where own texts stand a block goes only if half of the host's texts have it; headlines
(h1, and headings equal to the page's title) stay whatever has them. What the page itself says is further evidence: menus, adverts, forms and the like go even
if unique; beside a marked article only blocks of MIN_RUN or more tokens that are mostly unique stay.

A host of up to `shard_bytes` is judged in one task (`main_texts`). A larger one is judged in Spark with the same result (`host_wide`): its
suffixes carry ranks by prefix doubling over hashed tokens, an exchange by rank brings the array's equal neighbours together, and blocks, places
and votes are counted over all its pages. Numbers of near copies settle in rounds, since a page only points at earlier ones.

Defined cases: null and empty pages have empty text; a null or odd url is a host of its own; repeated ids and pages are rows of their own (equal
pages are copies; of ties the page first by id and html gives the number); a very long page is taken whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.markup import Block, blocks, title
from skyledger.llm.text import id_type, map_rows
from skyledger.plans.staging import stage

MIN_RUN = 4
COVERED = 0.5
SEVERAL = 3  # texts that have a block, at least, before it goes from an article
SHARED = 0.1  # and their share of the host's texts
SHARD_BYTES = 8 << 20  # of a host that one task judges; the result does not depend on it
PREFIX, SLOTS = 36, 10  # bits of a run's hash that are compared first, and those of them that deal the runs
UNIT = 1 << 20  # weights are whole numbers, so that sums do not depend on their order
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first `depth` tokens, and each suffix's rank: equal ranks begin alike.

    Prefix doubling: ranks by one token, then by 2, 4, ...; it stops early when all suffixes differ.
    """
    _, rank = np.unique(tokens, return_inverse=True)
    length = 1
    while length < depth and len(rank) and rank.max() + 1 < len(rank):
        step = min(length, depth - length)
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-step or None] = rank[step:] + 1 if step < len(rank) else 0
        _, rank = np.unique(rank * (rank.max() + 2) + ahead, return_inverse=True)
        length += step
    return np.argsort(rank, kind="stable"), rank


def covered(tokens: np.ndarray, page: np.ndarray, min_run: int = MIN_RUN) -> np.ndarray:
    """Tokens inside a run of `min_run` tokens that is found on two distinct pages. Runs do not cross separators (negative tokens)."""
    n = len(tokens)
    hit = np.zeros(n, bool)
    if n < min_run:
        return hit
    order, rank = suffix_array(tokens, min_run)
    same = rank[order[1:]] == rank[order[:-1]]
    group = np.concatenate([[0], np.cumsum(~same)])
    # A group of suffixes that begin alike counts if its least and greatest page differ.
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    pages = page[order]
    several = (np.minimum.reduceat(pages, starts) != np.maximum.reduceat(pages, starts))[group]
    begins = order[several]
    breaks = np.concatenate([[0], np.cumsum(tokens < 0)])
    begins = begins[begins + min_run <= n]
    begins = begins[breaks[begins + min_run] == breaks[begins]]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + min_run, -1)
    return np.cumsum(edge[:-1]) > 0


def _own(found: list[Block], pages: Counter) -> int:
    """The place of a page's own text among its blocks."""
    def weight(k: int) -> tuple:
        b = found[k]
        return not b.side, len(b.text.lower().split()) / sqrt(pages[b.text.lower()])
    return max(range(len(found)), key=weight)


def own_texts(parsed: list[list[Block]], min_run: int = MIN_RUN) -> tuple[list[int], list[Block | None]]:
    """A number for each page, the same for near copies and for pages without text; and each page's own text, its longest block for
    how many pages have it.

    What is compared are runs of `min_run` tokens of the marked article, or of the own text, each weighed like its block. A run points at the
    page that had it first; a page is a near copy of the page that at least half of its runs' weight points at.
    """
    pages = Counter(t for found in parsed for t in {b.text.lower() for b in found})
    own = [found[_own(found, pages)] if found else None for found in parsed]
    first: dict[tuple[str, ...], int] = {}
    numbers, fresh = [], 0
    for found, longest in zip(parsed, own):
        votes: dict[int, int] = defaultdict(int)
        runs, weight = [], 0
        for b in [b for b in found if b.main and not b.side] or [longest or Block("", (), False, False)]:
            words = b.text.lower().split()
            each = int(UNIT / sqrt(max(pages[b.text.lower()], 1)))
            for k in range(max(len(words) - min_run, 0) + 1):
                run = tuple(words[k:k + min_run])
                runs.append(run)
                weight += each
                if run in first:
                    votes[first[run]] += each
        best = max(votes, key=lambda n: (votes[n], -n), default=None)
        if best is None or votes[best] < COVERED * weight:
            best, fresh = fresh, fresh + 1
        for run in runs:
            first.setdefault(run, best)
        numbers.append(best)
    return numbers, own


def _headline(b: Block, heading: str) -> bool:
    """A headline of an article: h1, or a heading that says what the page's title says."""
    tags = {e.split(".")[0] for e in b.path}
    return b.main and ("h1" in tags or bool(tags & HEADINGS) and b.text.lower() == heading)


def _spoken(article: list[tuple], texts: Iterable[tuple], marked: bool, least: float, min_run: int) -> Iterator[tuple]:
    """Of one text's blocks those that enough texts have, and whether it speaks for them; blocks are (key, texts having it, words)."""
    spread, sums = sorted((n, size) for _, n, size in article), [0]
    sums += accumulate(size for _, size in spread)
    for text, n, size in texts:
        if size >= min_run and n >= least:
            held = sum(own for key, _, own in article if key == text) if marked else 0
            rarer, rest = sums[bisect_left(spread, (n / 2,))], sums[-1] - held
            yield text, rest > 0 and rarer >= COVERED * rest


def widespread(parsed: list[list[Block]], copies: list[int], own: list[Block | None], having: dict[str, set[int]], least: float,
               min_run: int = MIN_RUN) -> set[str]:
    """Blocks that several texts have beside text of their own, so that they are not what near copies share.

    A text speaks for a block if at least half of its article beside the block (without a marked article: its own text) is found in less than
    half as many texts; a block goes if at least half of the texts that have it speak for it.
    """
    votes: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    spoken = set()
    for k, found in enumerate(parsed):
        if copies[k] in spoken:
            continue
        spoken.add(copies[k])
        inner = [b for b in found if b.main and not b.side]
        article = [(b.text.lower(), len(having[b.text.lower()]), len(b.text.split())) for b in inner or [own[k]] if b]
        texts = {(b.text.lower(), len(having[b.text.lower()]), len(b.text.split())) for b in found if not b.side}
        for text, yes in _spoken(article, texts, bool(inner), least, min_run):
            votes[text][0] += 1
            votes[text][1] += yes
    return {text for text, (n, yes) in votes.items() if yes >= COVERED * n}


def main_texts(pages: list[str], min_run: int = MIN_RUN) -> list[str]:
    """Main text of each page of one host, or of a shard of it."""
    parsed = [blocks(p) for p in pages]
    number: dict[str, int] = {}
    stream, owner, spans, at = [], [], [], 0
    for k, found in enumerate(parsed):
        for b in found:
            words = b.text.lower().split()
            stream += [number.setdefault(w, len(number)) for w in words]
            owner += [k] * len(words)
            spans.append((at, at + len(words)))
            at += len(words)
        stream.append(-1)
        owner.append(k)
        at += 1
    copies, own = own_texts(parsed, min_run)
    own_places = {b.path for b in own if b}
    tokens, text_of = np.array(stream, np.int64), np.array(copies, np.int64)[np.array(owner, np.int64)]
    # Every separator differs from all others, so no repeat crosses a page.
    gaps = np.flatnonzero(tokens < 0)
    tokens[gaps] = -1 - np.arange(len(gaps))
    hit = covered(tokens, text_of, min_run)

    seen: dict[tuple[str, ...], list[int]] = defaultdict(lambda: [0, 0])
    having: dict[str, set[int]] = defaultdict(set)
    standing: dict[tuple[str, ...], set[int]] = defaultdict(set)
    counted, place = set(), 0
    for k, found in enumerate(parsed):
        first = copies[k] not in counted
        counted.add(copies[k])
        for b in found:
            a, z = spans[place]
            place += 1
            having[b.text.lower()].add(copies[k])
            standing[b.path].add(copies[k])
            if first:
                total = seen[b.path]
                total[0] += z - a
                total[1] += int(hit[a:z].sum())
    boilerplate = {path for path, (n, c) in seen.items() if c >= COVERED * n}
    least = max(SEVERAL, SHARED * len(counted))
    repeated = widespread(parsed, copies, own, having, least, min_run)

    texts, place = [], 0
    for page, found in zip(pages, parsed):
        marked = any(b.main and not b.side for b in found)
        heading = title(page).lower() if marked else ""
        kept = []
        for b in found:
            a, z = spans[place]
            place += 1
            if not b.side and _headline(b, heading):
                kept.append(b.text)
                continue
            among = b.main and b.path in own_places  # where articles of the host have their own text
            there = b.path in boilerplate and not (among or b.main and len(standing[b.path]) < least)
            low = b.text.lower()
            text = _kept(b, marked, there, low in repeated and (not among or len(having[low]) >= COVERED * len(counted)), hit[a:z], min_run)
            if text:
                kept.append(text)
        texts.append("\n".join(kept))
    return texts


def _kept(b: Block, marked: bool, boilerplate: bool, repeated: bool, hit: np.ndarray, min_run: int) -> str:
    if b.side or repeated:
        return ""
    if marked and not b.main and (len(hit) < min_run or hit.sum() > COVERED * len(hit)):
        return ""
    if boilerplate:
        return " ".join(w for w, h in zip(b.text.split(), hit) if not h)
    return b.text


def _ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """A hash of the `depth` tokens from every place on that has so many, by prefix doubling."""
    length = 1
    while length < depth:
        step = min(length, depth - length)
        ahead = tokens[step:]
        tokens = tokens[:len(ahead)] * np.uint64(0x9E3779B97F4A7C15) + (ahead ^ (ahead >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        tokens, length = tokens ^ (tokens >> np.uint64(32)), length + step
    return tokens


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_BLOCK = "array<struct<text: string, low: bigint, path: bigint, side: boolean, main: boolean, head: boolean, words: int>>"
_LONG, _INT = pa.int64(), pa.int32()


def _parsed(df: DataFrame) -> DataFrame:
    """One row a page, numbered by id and html, with its blocks; blocks and places are hashed with their host."""
    kind, arrow = id_type(df)
    block = pa.struct([("text", pa.string()), ("low", _LONG), ("path", _LONG), ("side", pa.bool_()), ("main", pa.bool_()), ("head", pa.bool_()), ("words", _INT)])
    schema = pa.schema([("page", _LONG), ("host", pa.string()), ("id", arrow), ("url", pa.string()), ("blocks", pa.list_(block))])

    def run(found: Iterable[tuple]) -> Iterator[tuple]:
        for page, host, key, url, html in found:
            html, seed = html.decode(), xxhash.xxh64_intdigest(host)
            parsed = blocks(html)
            heading = title(html).lower() if any(b.main and not b.side for b in parsed) else ""
            yield page, host.decode(), key, url.decode() if url is not None else None, [
                {"text": b.text, "low": _signed(xxhash.xxh64_intdigest(b.text.lower(), seed)), "path": _signed(xxhash.xxh64_intdigest(repr(b.path), seed)),
                 "side": b.side, "main": b.main, "head": not b.side and _headline(b, heading), "words": len(b.text.lower().split())} for b in parsed]

    # Range partitions are in order, so the numbers are too.
    ordered = df.orderBy(F.col("id").isNull(), "id", "html").withColumn("page", F.monotonically_increasing_id())
    return stage(map_rows(ordered, run, ["page", "host", "id", "url", "html"], f"page long, host string, id {kind}, url string, blocks {_BLOCK}", schema, 256), "parsed-pages")


class _Hashed:
    """Hashes of words, remembered, and of runs of them."""

    def __init__(self, min_run: int):
        self.min_run, self.known = min_run, {}

    def runs(self, words: list[str], seed: int) -> np.ndarray:
        """One for each run of `min_run` words."""
        if len(self.known) > 1 << 20:
            self.known = {}
        for w in words:
            if w not in self.known:
                self.known[w] = xxhash.xxh64_intdigest(w)
        if len(words) < self.min_run:
            return np.zeros(0, np.int64)
        return _ranks(np.array([self.known[w] for w in words], np.uint64) ^ np.uint64(seed), self.min_run).view(np.int64)

    def short(self, words: list[str], seed: int) -> int:
        """Of a block with fewer words."""
        return _signed(xxhash.xxh64_intdigest(" ".join(words), seed ^ 1))


def _found_twice(pages: DataFrame, min_run: int) -> DataFrame:
    """Prefixes of PREFIX bits of all runs' hashes that two runs have; written. Runs of any other prefix are on one page only.

    A task sends a slot of prefixes as one row of sorted differences, about two bytes a run, so that runs found once are not exchanged whole.
    """
    rest = PREFIX - SLOTS

    def send(found: Iterable[tuple]) -> Iterator[tuple]:
        hashed, held, size = _Hashed(min_run), [], 0

        def rows() -> Iterator[tuple]:
            values, times = np.unique(np.concatenate(held).view(np.uint64) >> np.uint64(64 - PREFIX), return_counts=True)
            values = np.repeat(values, np.minimum(times, 2))
            ends = np.searchsorted(values, np.arange(1 << SLOTS, dtype=np.uint64) << np.uint64(rest)).tolist() + [len(values)]
            low = (values & np.uint64((1 << rest) - 1)).astype(np.int64)
            for slot, (a, z) in enumerate(zip(ends, ends[1:])):
                if z > a:
                    yield slot, np.diff(low[a:z], prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()

        for _, host, texts in found:
            seed = xxhash.xxh64_intdigest(host)
            blocks_words = [t.lower().split() for t in texts]
            held.append(hashed.runs([w for words in blocks_words for w in words], seed))
            held.append(np.array([hashed.short(words, seed) for words in blocks_words if len(words) < min_run] if texts else [_signed(seed)], np.int64))
            size += len(held[-1]) + len(held[-2])
            if size >= 1 << 22:
                yield from rows()
                held, size = [], 0
        if held:
            yield from rows()

    def meet(group: pa.Table) -> pa.Table:
        own = [np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64))
               for raw in group.column("packed").to_pylist()]
        values, times = np.unique(np.concatenate(own), return_counts=True)
        return pa.table({"prefix": pa.array(values[times > 1] + (int(group.column("slot")[0].as_py()) << rest), _LONG)})

    sent = map_rows(pages.select("page", "host", F.col("blocks.text").alias("texts")), send, ["page", "host", "texts"], "slot int, packed binary",
                    pa.schema([("slot", _INT), ("packed", pa.binary())]), 64)
    return stage(sent.groupBy("slot").applyInArrow(meet, "prefix long"), "found-twice")


def _numbers(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """page and n, the number of its text: the first page of its near copies. `edges` say how much of a page's runs is first found on the earlier page q.

    A page follows the number that at least half of its runs' weight points at. Numbers of earlier pages do not depend on later ones, so rounds
    from any start end at the only solution.
    """
    may = edges.groupBy("page").agg(F.sum("w").alias("away")).join(pages, "page").where(F.col("away") >= COVERED * F.col("total")).select("page", "total")
    pointing = stage(edges.join(may, "page"), "pointing")
    number = stage(pointing.select("page").distinct().withColumn("n", F.col("page")).withColumn("moved", F.lit(True)), "numbers")
    while number.where("moved").head(1):
        at = pointing.join(number.select(F.col("page").alias("q"), "n"), "q", "left").groupBy("page", "total", F.coalesce("n", "q").alias("n")).agg(F.sum("w").alias("w"))
        best = at.groupBy("page", "total").agg(F.max(F.struct("w", (-F.col("n")).alias("less"))).alias("best"))
        best = best.select("page", F.when(F.col("best.w") >= COVERED * F.col("total"), -F.col("best.less")).otherwise(F.col("page")).alias("now"))
        number = stage(number.join(best, "page").select("page", F.col("now").alias("n"), (F.col("now") != F.col("n")).alias("moved")), "numbers")
    return pages.join(number, "page", "left").select("page", "host", F.coalesce("n", "page").alias("n"))


def _spread_hits(begins: list[int] | None, size: int, min_run: int) -> np.ndarray:
    edge = np.zeros(size + 1, np.int64)
    begins = np.array(begins or [], np.int64)
    edge[begins] += 1
    edge[np.minimum(begins + min_run, size)] -= 1
    return np.cumsum(edge[:-1]) > 0


def host_wide(df: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """id, url, text, n_chars of the pages of hosts of any size: `main_texts` of each host, as joins and counts over all its pages."""
    pages = _parsed(df)
    kind, arrow = id_type(df)
    flat = pages.select("page", "host", F.posexplode("blocks").alias("k", "b")).select(
        "page", "host", "k", "b.low", "b.path", "b.side", "b.main", "b.words")
    inner = F.col("main") & ~F.col("side")

    # The page's own text, and whether it has a marked article.
    having_pages = flat.select("page", "low").distinct().groupBy("low").agg(F.count(F.lit(1)).alias("pages"))
    own = stage(flat.join(having_pages, "low").groupBy("page").agg(
        F.max(F.struct(~F.col("side"), F.col("words") / F.sqrt("pages"), -F.col("k"), "k", "path")).alias("own"), F.max(inner).alias("marked"),
        F.sort_array(F.collect_list(F.struct("k", "pages"))).alias("of"))
        .select("page", "marked", F.col("own.k").alias("own_k"), F.col("own.path").alias("own_path"), "of.pages"), "own-texts")

    # Near copies: a page's runs, each with its weight, and who had them first.
    def article(found: Iterable[tuple]) -> Iterator[tuple]:
        hashed = _Hashed(min_run)
        for page, host, held, marked, own_k, having in found:
            seed, total = xxhash.xxh64_intdigest(host), 0
            if not held:
                yield page, _signed(seed), UNIT
                total = UNIT
            for k, b in enumerate(held):
                if (b["main"] and not b["side"]) if marked else k == own_k:
                    words, each = b["text"].lower().split(), int(UNIT / sqrt(having[k]))
                    for run in hashed.runs(words, seed).tolist() or [hashed.short(words, seed)]:
                        yield page, run, each
                        total += each
            yield page, None, total

    twice = _found_twice(pages, min_run)
    prefix = lambda of: F.shiftrightunsigned(of, 64 - PREFIX)
    texts = pages.select("page", "host", F.expr("transform(blocks, b -> struct(b.text, b.side, b.main))").alias("blocks")).join(own, "page", "left")
    runs = map_rows(texts, article, ["page", "host", "blocks", "marked", "own_k", "pages"], "page long, run long, each long",
                    pa.schema([("page", _LONG), ("run", _LONG), ("each", _LONG)]), 1 << 16)
    runs = stage(runs.join(twice, prefix("run") == F.col("prefix"), "left").where("prefix is not null or run is null").drop("prefix"), "article-runs")
    total, runs = runs.where("run is null").select("page", F.col("each").alias("total")), runs.where("run is not null")
    shared = stage(runs.groupBy("run").agg(F.min("page").alias("q"), F.max("page").alias("z")).where("q < z").select("run", "q"), "shared-runs")
    edges = stage(runs.join(shared, "run").where("q < page").groupBy("page", "q").agg(F.sum("each").alias("w")), "edges")
    number = stage(_numbers(pages.select("page", "host").join(total, "page"), edges), "texts")
    hosts = number.groupBy("host").agg(F.countDistinct("n").alias("texts"))

    # The array: suffixes by rank, and those of equal rank on two distinct texts.
    def suffix(found: Iterable[tuple]) -> Iterator[tuple]:
        hashed = _Hashed(min_run)
        for page, host, held in found:
            for at, rank in enumerate(hashed.runs([w for text in held for w in text.lower().split()], xxhash.xxh64_intdigest(host)).tolist()):
                yield page, at, rank

    suffixes = map_rows(pages.select("page", "host", F.col("blocks.text").alias("texts")), suffix, ["page", "host", "texts"], "page long, at int, rank long",
                        pa.schema([("page", _LONG), ("at", _INT), ("rank", _LONG)]), 1 << 16)
    suffixes = stage(suffixes.join(twice, prefix("rank") == F.col("prefix"), "left_semi"), "suffixes")
    numbered = suffixes.select("page", "rank").join(number.select("page", "n"), "page")
    repeats = stage(numbered.groupBy("rank").agg(F.min("n").alias("a"), F.max("n").alias("z")).where("a < z").select("rank"), "repeated-ranks")
    begins = stage(suffixes.join(repeats, "rank").groupBy("page").agg(F.collect_list("at").alias("begins")), "repeats")

    def count(found: Iterable[tuple]) -> Iterator[tuple]:
        for page, sizes, at in found:
            hit, done = _spread_hits(at, sum(sizes), min_run), 0
            for k, size in enumerate(sizes):
                yield page, k, int(hit[done:done + size].sum())
                done += size

    sized = pages.select("page", F.col("blocks.words").alias("sizes")).join(begins, "page", "left")
    hits = map_rows(sized, count, ["page", "sizes", "begins"], "page long, k int, hit int", pa.schema([("page", _LONG), ("k", _INT), ("hit", _INT)]))
    placed = flat.join(hits, ["page", "k"]).join(number.select("page", "n"), "page").join(hosts, "host")
    placed = stage(placed.withColumn("least", F.greatest(F.lit(float(SEVERAL)), F.lit(SHARED) * F.col("texts"))), "placed")

    # What the host's texts say of blocks and places; a text's first page counts its tokens.
    first = F.col("page") == F.col("n")
    having = stage(placed.select("low", "n").distinct().groupBy("low").agg(F.count(F.lit(1)).alias("having")), "having")
    paths = placed.groupBy("path").agg(F.sum(F.when(first, F.col("words"))).alias("tokens"), F.sum(F.when(first, F.col("hit"))).alias("hits"))
    standing = placed.select("path", "n").distinct().groupBy("path").agg(F.count(F.lit(1)).alias("standing"))
    among = own.select(F.col("own_path").alias("path")).distinct().withColumn("among", F.lit(True))
    paths = paths.join(standing, "path").join(among, "path", "left").select(
        "path", "standing", F.coalesce("among", F.lit(False)).alias("among"), F.coalesce(F.col("hits") >= COVERED * F.col("tokens"), F.lit(False)).alias("boilerplate"))

    def speak(found: Iterable[tuple]) -> Iterator[tuple]:
        for least, own_k, held in found:
            inside = [b for b in held if b["main"] and not b["side"]]
            article = [(b["low"], b["having"], b["words"]) for b in inside or [b for b in held if b["k"] == own_k]]
            yield from _spoken(article, {(b["low"], b["having"], b["words"]) for b in held if not b["side"]}, bool(inside), least, min_run)

    held = placed.where(first).join(having, "low").groupBy("page", "least").agg(F.collect_list(F.struct("k", "low", "having", "words", "main", "side")).alias("held"))
    votes = map_rows(held.join(own, "page").select("least", "own_k", "held"), speak, ["least", "own_k", "held"], "low long, yes boolean",
                     pa.schema([("low", pa.int64()), ("yes", pa.bool_())]))
    repeated = votes.groupBy("low").agg((F.sum(F.col("yes").cast("int")) >= COVERED * F.count(F.lit(1))).alias("repeated"))

    judged = placed.join(having.join(repeated, "low", "left"), "low").join(paths, "path")
    beside = F.col("main") & F.col("among")
    judged = judged.select("page", F.struct(
        "k", (F.col("boilerplate") & ~(beside | F.col("main") & (F.col("standing") < F.col("least")))).alias("there"),
        (F.coalesce("repeated", F.lit(False)) & (~beside | (F.col("having") >= COVERED * F.col("texts")))).alias("gone")).alias("flag"))
    judged = judged.groupBy("page").agg(F.sort_array(F.collect_list("flag")).alias("flags"))

    def write(found: Iterable[tuple]) -> Iterator[tuple]:
        for key, url, held, at, flags in found:
            hit, done, kept = _spread_hits(at, sum(b["words"] for b in held), min_run), 0, []
            marked = any(b["main"] and not b["side"] for b in held)
            for b, flag in zip(held, flags or []):
                own = hit[done:done + b["words"]]
                done += b["words"]
                text = b["text"] if b["head"] else _kept(Block(b["text"], (), b["side"], b["main"]), marked, flag["there"], flag["gone"], own, min_run)
                if text:
                    kept.append(text)
            text = "\n".join(kept)
            yield key, url.decode() if url is not None else None, text, len(text)

    due = pages.select("page", "id", "url", F.expr("transform(blocks, b -> struct(b.text, b.side, b.main, b.head, b.words))").alias("blocks"))
    due = due.join(begins, "page", "left").join(judged, "page", "left").select("id", "url", "blocks", "begins", "flags")
    return map_rows(due, write, ["id", "url", "blocks", "begins", "flags"], f"id {kind}, url string, text string, n_chars long",
                    pa.schema([("id", arrow), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]), 256)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_run: int = MIN_RUN,
            shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """id, url, text, n_chars of every page."""
    host = F.lower(F.regexp_extract(F.coalesce(pages[url_col].cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    df = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"), host.alias("host"))
    large = stage(df.groupBy("host").agg(F.sum(F.octet_length("html")).alias("size")).where(F.col("size") > shard_bytes).select("host"), "large-hosts")
    kind, arrow = id_type(df)
    schema = pa.schema([("id", arrow), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("html", "ascending")])
        texts = main_texts(group.column("html").to_pylist(), min_run)
        return pa.table([group.column("id"), group.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    small = df.join(large, "host", "left_anti").groupBy("host").applyInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return small.unionByName(host_wide(df.join(large, "host", "left_semi"), min_run)) if large.head(1) else small

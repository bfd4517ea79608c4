"""Short codes for vectors: product quantisation by Lloyd's algorithm whose members stay where they are.

A vector is cut into parts; each part position has a codebook of its own. The rows that are worked on are members, parts
of vectors, dealt once by (position, entry, salt) into a table in the shared folder. In a round owners add up
their resident members, which gives the new codebook, compare them with it, and send on only the parts whose
nearest entry has changed; the shuffle deals these to their new owners, who keep them in a
table of that round. A member of an earlier round's table is resident as long as the codebooks since have kept its entry, so
no table is written again. Codebooks are all that the driver holds: entries x dimensions integers a round.

Members travel in blocks: parts of one input batch under one owner are one row (their places in the batch, and their
integers as bytes). The salt is a hash of the batch modulo a number that follows from the count of vectors, so a very
frequent vector spreads over as many owners as its rows need. All arithmetic is on integers and exact.

Defined cases: rows whose vector is null or holds a null, an infinity or no number are dropped; a shorter vector counts as
ending in zeros, and so does a dimension that is no multiple of the parts; a component whose square could not be held in the
error saturates (the limit is 2^30 / sqrt(dimensions) after scaling); repeated ids and repeated rows each keep their row, and
seeds with one id are taken in order of their components; null ids come after all others as seeds; fewer vectors than
entries give fewer entries; an entry without members stays; ties go to the lower entry; null labels are one label; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import text as X
from skyledger.plans.staging import stage

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
SALT_ROWS = 1024  # vectors to a salt

MEMBERS, HEADS = 0, 1  # kinds of rows
KINDS = "kind int, position int, entry int, base long, since int, places binary, data binary"
ARROW = pa.schema([("kind", pa.int32()), ("position", pa.int32()), ("entry", pa.int32()), ("base", pa.int64()), ("since", pa.int32()),
                   ("places", pa.binary()), ("data", pa.binary())])
SUMS = pa.schema([("position", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
NAMES = ARROW.names


class Shape:
    """Parts, their width, and the integers' byte width, which all follow from the table."""

    def __init__(self, longest: int, greatest: float, parts: int, scale: int):
        self.parts, self.width, self.scale = parts, -(-longest // parts), scale
        self.limit = int(2**30 / max(self.width * parts, 1) ** 0.5)
        top = min(int(min(greatest, 1e300) * scale) + 1, self.limit)
        self.kind = "<i2" if top < 1 << 15 else "<i4"
        #: Distances fit a double's 53 bits: products of floats are exact then.
        self.small = 4 * self.width * top * top < 1 << 53

    def integers(self, vectors: pa.Array) -> np.ndarray:
        """Scaled and floored components, one row a vector, in parts."""
        lengths = np.diff(vectors.offsets.to_numpy())
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        limit = float(self.limit)
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(values * self.scale), -limit, limit).astype(self.kind)
        out = np.zeros((len(lengths), self.parts * self.width), self.kind)
        if len(values):
            row = np.repeat(np.arange(len(lengths)), lengths)
            out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = whole
        return out

    def nearest(self, x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each part (ties to the lower one) and its squared distance."""
        kind = np.float64 if self.small else np.int64
        x, book = x.astype(kind), book.astype(kind)
        # |x|^2 is the same for all entries and is added at the end.
        score = (book * book).sum(1) - 2 * (x @ book.T)
        at = score.argmin(1)
        return at, (score[np.arange(len(x)), at] + (x * x).sum(1)).astype(np.int64)


def _blocks(position: np.ndarray, entry: np.ndarray, base: np.ndarray, place: np.ndarray, x: np.ndarray, since: int) -> Iterator[tuple]:
    """One row for each (position, entry, batch) among the parts."""
    order = np.lexsort((place, base, entry, position))
    position, entry, base, place, x = position[order], entry[order], base[order], place[order], x[order]
    new = (position[1:] != position[:-1]) | (entry[1:] != entry[:-1]) | (base[1:] != base[:-1])
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(order)] if len(order) else [0]
    for s, e in zip(cuts, cuts[1:]):
        yield MEMBERS, int(position[s]), int(entry[s]), int(base[s]), since, place[s:e].astype("<u2").tobytes(), x[s:e].tobytes()


def _unpacked(rows: list[tuple], shape: Shape):
    """Arrays over the parts of several blocks: position, entry, batch, since, place in the batch, components."""
    places = [np.frombuffer(r[5], "<u2") for r in rows]
    n = [len(p) for p in places]
    spread = lambda k: np.repeat(np.array([r[k] for r in rows], np.int64), n)
    x = np.frombuffer(b"".join([r[6] for r in rows]), shape.kind).reshape(sum(n), shape.width)
    return spread(1), spread(2), spread(3), spread(4), np.concatenate(places).astype(np.int64), x


def _gathered(found: Iterable[tuple], parts: int = 1 << 16) -> Iterator[list[tuple]]:
    held, n = [], 0
    for row in found:
        held.append(row)
        n += len(row[5] or b"") // 2
        if n >= parts:
            yield held
            held, n = [], 0
    if held:
        yield held


def _resident(rows: list[tuple], shape: Shape, books: list[np.ndarray]):
    """The members that were still under their entry after the last but one codebook, with what the last one says."""
    position, entry, base, since, place, x = _unpacked(rows, shape)
    here = np.ones(len(position), bool)
    now, distance = entry.copy(), np.zeros(len(position), np.int64)
    for number, book in enumerate(books):
        last = number == len(books) - 1
        for p in range(shape.parts):
            which = np.flatnonzero(here & (position == p) & (since < number))
            if len(which):
                at, far = shape.nearest(x[which], book[p])
                if last:
                    now[which], distance[which] = at, far
                else:
                    here[which] = at == entry[which]
    return tuple(c[here] for c in (position, entry, now, distance, base, place, x))


def fit_codes(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
              entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """id, label, code (hex, two digits a part) and error of every kept vector; and the codebooks, one array (entry, component) a part."""
    spark = vectors.sparkSession
    real = vectors.schema[vector_col].dataType.elementType.simpleString() in ("float", "double")
    usable = lambda v: v.isNotNull() & (~F.isnan(v) & (F.abs(v) < float("inf")) if real else F.lit(True))
    df = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vector_col].alias("v"))
    df = df.where(F.col("v").isNotNull() & F.coalesce(F.forall("v", usable), F.lit(True)))
    size = df.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda v: F.abs(v.cast("double")))))).head()
    shape = Shape(size[1] or 0, size[2] or 0.0, parts, scale)
    salts = -(-size[0] // SALT_ROWS) or 1
    whole = F.transform("v", lambda v: F.floor(v.cast("double") * scale))
    seeds = df.orderBy(F.col("id").asc_nulls_last(), whole).limit(entries).select("v").toArrow().column("v").combine_chunks()
    first = shape.integers(seeds).astype(np.int64)
    n_entries = len(first)
    books = [np.ascontiguousarray(first.reshape(n_entries, parts, shape.width).transpose(1, 0, 2))]
    id_kind, id_arrow = X.id_type(df)
    label_kind, label_arrow = X.id_type(df.select(F.col("label").alias("id")))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Parts of the input under their first entries, and ids and labels as a row of each batch."""
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        for batch in batches:
            for k in range(0, batch.num_rows, 1 << 14):
                piece = batch.slice(k, 1 << 14)
                n = piece.num_rows
                held = pa.BufferOutputStream()
                heads = piece.select(["id", "label"])
                with pa.ipc.new_stream(held, heads.schema) as out:
                    out.write_batch(heads)
                yield HEADS, -1, 0, base, 0, None, held.getvalue().to_pybytes()
                x = shape.integers(piece.column("v")).reshape(n, parts, shape.width)
                for p in range(parts):
                    entry, _ = shape.nearest(x[:, p], books[0][p])
                    yield from _blocks(np.full(n, p), entry, np.full(n, base), np.arange(n), x[:, p], 0)
                base += n

    def leave(history: list[np.ndarray]):
        """Residents whose nearest entry has changed, on their way to their new owners."""
        def run(found: Iterable[tuple]) -> Iterator[tuple]:
            for rows in _gathered(found):
                position, entry, now, _, base, place, x = _resident(rows, shape, history)
                moves = now != entry
                yield from _blocks(position[moves], now[moves], base[moves], place[moves], x[moves], len(history) - 1)
        return run

    def add_up(history: list[np.ndarray]):
        """Sums and counts of the residents of each entry, over one task's blocks: positions x entries rows at most."""
        def run(found: Iterable[tuple]) -> Iterator[tuple]:
            sums = np.zeros((parts, n_entries, shape.width), np.int64)
            n = np.zeros((parts, n_entries), np.int64)
            for rows in _gathered(found):
                position, entry, now, _, _, _, x = _resident(rows, shape, history)
                stay = now == entry
                np.add.at(sums, (position[stay], entry[stay]), x[stay])
                np.add.at(n, (position[stay], entry[stay]), 1)
            for p, e in zip(*np.nonzero(n)):
                yield int(p), int(e), int(n[p, e]), sums[p, e].tolist()
        return run

    def owned(rows: DataFrame) -> DataFrame:
        """Rows dealt to their owners and kept there."""
        return stage(rows.repartition("position", "entry", F.pmod(F.xxhash64("base"), F.lit(salts))), "members")

    def updated(tables: list[DataFrame], books: list[np.ndarray]) -> np.ndarray:
        """New entries from the owners' sums over their residents; positions x entries x width rows reach the driver."""
        new = books[-1].copy()
        sums = X.map_rows(_members(tables), add_up(list(books)), NAMES, "position int, entry int, n long, sums array<long>", SUMS)
        sums = sums.select("position", "entry", "n", F.posexplode("sums").alias("at", "s"))
        for p, e, k, n, s in sums.groupBy("position", "entry", "at").agg(F.sum("n"), F.sum("s")).collect():
            new[p, e, k] = s // n
        return new

    schema = "id " + id_kind + ", label " + label_kind + ", code string, error long"
    if not n_entries:
        return spark.createDataFrame([], schema), []
    start = df.select("id", "label", "v").mapInArrow(lambda batches: X.batched(settle(batches), ARROW, 512), KINDS)
    tables = [owned(start)]
    for _ in range(rounds - 1):
        books.append(updated(tables, books))
        tables.append(owned(X.map_rows(_members(tables), leave(list(books)), NAMES, KINDS, ARROW, 512)))
    books.append(updated(tables, books))

    def final(found: Iterable[tuple]) -> Iterator[tuple]:
        """Of each batch and position the places, last entries and distances."""
        for rows in _gathered(found):
            position, _, now, distance, base, place, _ = _resident(rows, shape, books)
            order = np.lexsort((place, base, position))
            position, now, distance, base, place = (c[order] for c in (position, now, distance, base, place))
            new = (position[1:] != position[:-1]) | (base[1:] != base[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(order)] if len(order) else [0]
            for s, e in zip(cuts, cuts[1:]):
                yield (MEMBERS, int(position[s]), 0, int(base[s]), 0, place[s:e].astype("<u2").tobytes(),
                       now[s:e].astype("<u2").tobytes() + distance[s:e].astype("<i8").tobytes())

    def whole_batch(table: pa.Table) -> pa.Table:
        """Codes of the vectors of one input batch, 2^14 at most, from their parts' rows."""
        rows = list(X.rows(table.to_batches(), "kind", "position", "places", "data"))
        head = next(r for r in rows if r[0] == HEADS)
        heads = pa.ipc.open_stream(head[3]).read_all()
        n = heads.num_rows
        entry, error = np.zeros((n, parts), np.int64), np.zeros(n, np.int64)
        for kind, position, places, data in rows:
            if kind == MEMBERS:
                place = np.frombuffer(places, "<u2")
                entry[place, position] = np.frombuffer(data, "<u2", len(place))
                error[place] += np.frombuffer(data, "<i8", len(place), 2 * len(place))
        digits = [f"{k:02x}" for k in range(n_entries)]
        codes = ["".join([digits[k] for k in row]) for row in entry.tolist()]
        return pa.table({"id": heads.column("id").cast(id_arrow), "label": heads.column("label").cast(label_arrow), "code": pa.array(codes, pa.string()),
                         "error": pa.array(error, pa.int64())})

    ends = X.map_rows(_members(tables), final, NAMES, KINDS, ARROW, 512)
    heads = tables[0].where(F.col("kind") == HEADS)
    coded = heads.unionByName(ends).select("kind", "position", "base", "places", "data").groupBy("base").applyInArrow(whole_batch, schema)
    return coded, list(books[-1])


def _members(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out.where(F.col("kind") == MEMBERS)


def books_text(books: list[np.ndarray]) -> str:
    """All entries' integers by part, entry and place, joined by commas."""
    return ",".join(str(v) for part in books for v in part.ravel().tolist())


def report(vectors: DataFrame, **options) -> DataFrame:
    """id, code, error, the error summed over equal labels, and the digest of the codebooks."""
    coded, books = fit_codes(vectors, **options)
    coded = stage(coded, "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    by_label = coded.groupBy("label").agg(F.least(total, most).cast("long").alias("label_error")).withColumnRenamed("label", "__label")
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["__label"])).select(
        "id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

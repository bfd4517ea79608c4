"""A hidden Markov language model, trained by Baum-Welch over all training documents.

A word is emitted in two steps: the state emits the word's class (a hash of its first and last two bytes, so classes
are bounded in number whatever the vocabulary), and the class emits the word by its count in the training
documents, with one more type for words not seen. Every iteration adds up expected counts inside each
partition, then across partitions; only the model itself, of fixed size, reaches the driver. Scoring runs the
scaled forward recursion over the whole text: each segment's product of transition and emission matrices is
computed beside many others, and a text's likelihood is the product of its segments', which is exact.

Counts of words never reach one machine: texts are coded in chunks with a vocabulary of their own, the
chunk vocabularies are joined with the global counts, and a chunk meets its counts again by chunk number. Coded texts are
written to the shared folder once and read in every iteration.

Defined cases: null and empty texts are the end token alone; null ids count as the empty text in the split; repeated ids are
rows of their own; other columns are ignored; without training documents every token is unknown and
classes are equally likely; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm import text as X
from skyledger.plans.staging import new_folder, stage

STATES = 8
CLASSES = 8192
ITERATIONS = 4
CHUNK_TOKENS = 4_000_000
SEGMENT = 128  # tokens; training restarts from the initial distribution at each, scoring does not
END = b""  # no word is empty, so the empty word is the end token
STAY = 0.9


def class_of(word: bytes, classes: int = CLASSES) -> int:
    """0 for the end token alone."""
    return 1 + xxhash.xxh64_intdigest(word[:2] + b" " + word[-2:], 3) % (classes - 1) if word else 0


def classes_of(words: pa.LargeBinaryArray, classes: int = CLASSES) -> np.ndarray:
    """`class_of` of many words: once for each length up to two and first and last two bytes."""
    if not len(words):
        return np.zeros(0, np.uint16)
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.concatenate([np.frombuffer(words.buffers()[2] or b"", np.uint8), np.zeros(2, np.uint8)]).astype(np.int64)
    a, z = at[:-1], at[1:]
    size = np.minimum(z - a, 2)
    key = ((data[a] << 24) | (data[np.minimum(a + 1, z)] << 16) | (data[np.maximum(z - 2, a)] << 8) | data[np.maximum(z - 1, 0)]) * 3 + size
    key[size == 1] = data[a[size == 1]] * 3 + 1
    key[size == 0] = 0
    _, first, same = np.unique(key, return_index=True, return_inverse=True)
    return np.array([class_of(w, classes) for w in words.take(pa.array(first)).to_pylist()], np.uint16)[same]


# ---------------------------------------------------------------- coding


def pack(codes: np.ndarray) -> bytes:
    """Codes as four planes of bytes: the high planes are mostly zeros, which Parquet and shuffles compress away."""
    return np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def code(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES,
         chunk_tokens: int = CHUNK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Texts as word codes and classes, and the words of each chunk with their training counts; both written."""
    df = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    kind, arrow = X.id_type(df)
    schema = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("id", arrow), ("training", pa.bool_()), ("codes", pa.binary()),
                        ("classes", pa.binary()), ("word", pa.string()), ("code", pa.int32()), ("class", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        chunk, held, size = 0, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            texts = rows.column(1).cast(pa.large_string()).combine_chunks()
            cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts))
            found = pc.list_flatten(cut).dictionary_encode()
            number, flat, ends = found.dictionary.view(pa.large_binary()), found.indices.to_numpy() + 1, cut.offsets.to_numpy()
            # Blanks at a text's ends leave empty words, which are none.
            empty = pc.index(number, b"").as_py()
            if empty >= 0:
                real = flat != empty + 1
                ends = np.concatenate([[0], np.cumsum(real)])[ends]
                flat = flat[real]
                flat[flat > empty + 1] -= 1
                number = pa.concat_arrays([number[:empty], number[empty + 1:]])
            number = pa.concat_arrays([pa.array([END], pa.large_binary()), number])
            coded = [np.append(flat[a:z], 0).astype(np.int32) for a, z in zip(ends.tolist(), ends[1:].tolist())]
            shape = classes_of(number, classes)
            used = rows.column(2).to_numpy()
            seen = np.bincount(flat[np.repeat(used, np.diff(ends))], minlength=len(number)).astype(np.int64)
            seen[0] = used.sum()
            here = base + chunk
            for k in range(0, len(coded), 1024):
                part, codes = rows.slice(k, 1024), coded[k:k + 1024]
                yield _filled(schema, len(codes), kind=["text"] * len(codes), chunk=[here] * len(codes), id=part.column(0).combine_chunks(),
                              training=part.column(2).combine_chunks(), codes=[pack(c) for c in codes], classes=[shape[c].tobytes() for c in codes])
            words = number.view(pa.large_string())
            for k in range(0, len(words), 1 << 16):
                part = words[k:k + (1 << 16)].cast(pa.string())
                yield _filled(schema, len(part), kind=pa.repeat("word", len(part)), chunk=pa.repeat(pa.scalar(here, pa.int64()), len(part)), word=part,
                              code=np.arange(k, k + len(part), dtype=np.int32), n=seen[k:k + len(part)], **{"class": shape[k:k + len(part)].astype(np.int32)})

        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64) // 5 + 1)
            start, taken = 0, 0
            while start < len(batch):
                stop = min(int(np.searchsorted(sizes, taken + chunk_tokens - size)) + 1, len(batch))
                held.append(batch.slice(start, stop - start))
                size += int(sizes[stop - 1]) - taken
                start, taken = stop, int(sizes[stop - 1])
                if size >= chunk_tokens:
                    yield from done()
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield from done()

    spark, path = docs.sparkSession, new_folder(docs.sparkSession, "coded")
    kinds = f"kind string, chunk long, id {kind}, training boolean, codes binary, classes binary, word string, code int, class int, n long"
    df.mapInArrow(run, kinds).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    part = lambda name: spark.read.schema(kinds).parquet(path).where(F.col("kind") == name)
    return part("text").select("chunk", "id", "training", "codes", "classes"), part("word").select("chunk", "word", "code", "class", "n")


def _filled(schema: pa.Schema, size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [_column(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def _column(held, kind: pa.DataType) -> pa.Array:
    if isinstance(held, pa.ChunkedArray):
        held = pa.concat_arrays(held.chunks)
    return held.cast(kind) if isinstance(held, pa.Array) else pa.array(held, kind)


# ---------------------------------------------------------------- training


@dataclass
class Model:
    start: np.ndarray  # of states
    move: np.ndarray  # from state, to state
    emit: np.ndarray  # class, state


def initial(states: int = STATES, classes: int = CLASSES) -> Model:
    """States that tend to stay, with emissions drawn around equal ones; the same at every run."""
    rng = np.random.default_rng(11)
    move = np.full((states, states), (1 - STAY) / max(states - 1, 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    emit = rng.uniform(0.5, 1.5, (classes, states))
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _segments(held: list[np.ndarray], length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Texts cut into rows of `length` classes, longest first, and the rows' lengths."""
    parts = [c[k:k + length] for c in held for k in range(0, len(c), length)]
    parts.sort(key=len, reverse=True)
    sizes = np.array([len(p) for p in parts], np.int64)
    table = np.zeros((len(parts), length), np.int64)
    table[np.arange(length) < sizes[:, None]] = np.concatenate(parts)
    return table, sizes


def expected_counts(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions over segments: scaled forward and backward passes, many segments at a time."""
    states = len(model.start)
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit)
    A, E, at_start = model.move.astype(np.float32), model.emit.astype(np.float32), model.start.astype(np.float32)
    ones = np.ones((states, 1), np.float32)  # sums over states are products: numpy's sums along a short axis are slow
    table, sizes = _segments(texts)
    for k in range(0, len(table), 2048):
        rows, own = table[k:k + 2048], sizes[k:k + 2048]
        steps = int(own[0])
        alive = [int(np.searchsorted(-own, -t, "left")) for t in range(steps)]  # rows longer than t; they are sorted
        seen = np.ascontiguousarray(rows.T)
        alpha, likely = np.empty((steps, len(rows), states), np.float32), np.empty((steps, len(rows), states), np.float32)
        for t in range(steps):
            n = alive[t]
            likely[t, :n] = E[seen[t, :n]]
            now = (at_start if t == 0 else alpha[t - 1, :n] @ A) * likely[t, :n]
            alpha[t, :n] = now / np.maximum(now @ ones, 1e-30)
        beta = np.ones((len(rows), states), np.float32)
        for t in range(steps - 1, -1, -1):
            n = alive[t]
            if t + 1 < steps and (m := alive[t + 1]):
                ahead = likely[t + 1, :m] * beta[:m]
                back = ahead @ A.T
                scale = np.maximum((alpha[t, :m] * back) @ ones, 1e-30)
                move += (alpha[t, :m] / scale).T.astype(np.float64) @ ahead * A
                beta[:m] = back / np.maximum(back @ ones, 1e-30)
            gamma = alpha[t, :n] * beta[:n]
            gamma /= np.maximum(gamma @ ones, 1e-30)
            alpha[t, :n] = gamma  # no longer needed as it was
            if t == 0:
                start += gamma.sum(axis=0)
        inside = np.arange(steps)[:, None] < own[None, :]
        which, weight = seen[:steps][inside], alpha[inside]
        for s in range(states):
            emit[:, s] += np.bincount(which, weight[:, s], len(emit))
    return start, move, emit


def train(coded: DataFrame, shapes: np.ndarray, *, states: int = STATES, classes: int = CLASSES, iterations: int = ITERATIONS) -> Model:
    """Baum-Welch over all training texts. `shapes` are the classes' shares of all training words, used for smoothing."""
    model, spark = initial(states, classes), coded.sparkSession
    texts = coded.where("training").select("classes")
    for _ in range(iterations):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                held = [np.frombuffer(b, np.uint16) for b in batch.column(0).to_pylist()]
                if not held:
                    continue
                got = expected_counts(sent.value, held)
                total = got if total is None else tuple(a + b for a, b in zip(total, got))
            if total is not None:
                table = np.concatenate([total[2], total[1], total[0][None]]).astype(np.float32)
                slices = [table[k:k + 256].tobytes() for k in range(0, len(table), 256)]
                yield pa.RecordBatch.from_pydict({"slice": pa.array(range(len(slices)), pa.int32()), "counts": pa.array(slices, pa.binary())})

        def add(found: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(b, np.float32).astype(np.float64) for b in found.column("counts").to_pylist())
            return pa.table({"slice": found.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

        parts = texts.mapInArrow(run, "slice int, counts binary")
        # Partitions first meet in a few dozen groups, so that no task holds the counts of all of them.
        parts = parts.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(32)))
        half = parts.groupBy("slice", "group").applyInArrow(add32, "slice int, counts binary")
        got = sorted((r.slice, r.counts) for r in half.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect())
        if not got:
            break
        table = np.concatenate([np.frombuffer(bytes(b), np.float64) for _, b in got]).reshape(-1, states)
        emit, move, start = table[:classes], table[classes:classes + states], table[-1]
        emit = emit + 10.0 * shapes[:, None]
        move, start = move + 0.1, start + 0.1
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model


def add32(found: pa.Table) -> pa.Table:
    """Sum of partial counts, as 32-bit floats."""
    total = sum(np.frombuffer(b, np.float32).astype(np.float64) for b in found.column("counts").to_pylist())
    return pa.table({"slice": found.column("slice")[:1], "counts": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


# ---------------------------------------------------------------- scoring


def log_likelihoods(model: Model, texts: list[np.ndarray], length: int = SEGMENT, together: int = 1024) -> np.ndarray:
    """Exact natural log-likelihood of each text's classes.

    A segment's matrix is the product of its steps' transition and emission matrices, scaled at every step;
    a text's likelihood is the initial distribution times the product of its segments.
    """
    states = len(model.start)
    parts = [(t, k, c[k:k + length]) for t, c in enumerate(texts) for k in range(0, len(c), length)]
    order = sorted(range(len(parts)), key=lambda p: -len(parts[p][2]))
    product, scale = np.empty((len(parts), states, states)), np.zeros(len(parts))
    for k in range(0, len(order), together):
        own = order[k:k + together]
        sizes = np.array([len(parts[p][2]) for p in own])
        table = np.zeros((len(own), int(sizes[0])), np.int64)
        table[np.arange(table.shape[1]) < sizes[:, None]] = np.concatenate([parts[p][2] for p in own])
        now, logs = np.broadcast_to(np.eye(states), (len(own), states, states)).copy(), np.zeros(len(own))
        for t in range(table.shape[1]):
            n = int(np.searchsorted(-sizes, -t, "left"))
            step = now[:n].reshape(-1, states)
            # The first step of a text has no transition.
            step = step @ model.move
            step = step.reshape(n, states, states)
            if t == 0:
                first = np.array([parts[p][1] == 0 for p in own[:n]])
                step[first] = now[:n][first]
            step = step * model.emit[table[:n, t]][:, None, :]
            total = step.reshape(n, -1) @ np.ones(states * states)
            now[:n] = step / total[:, None, None]
            logs[:n] += np.log(total)
        product[own], scale[own] = now, logs
    out = np.zeros(len(texts))
    state = None
    for (t, k, _), matrix, logs in zip(parts, product, scale):
        state = model.start @ matrix if k == 0 else state @ matrix
        total = state.sum()
        state = state / total
        out[t] += logs + np.log(total)
    return out


def score(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, classes: int = CLASSES,
          iterations: int = ITERATIONS, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """id, training, n_tokens, n_known, train_tokens, base_score, score (log10) of every text."""
    texts, words = code(docs, training, id_col=id_col, text_col=text_col, classes=classes, chunk_tokens=chunk_tokens)
    counts = stage(words.groupBy("word").agg(F.sum("n").alias("c"), F.first("class").alias("class")).where("c > 0"), "word-counts")
    # Bounded by the number of classes.
    found = counts.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    n_class, v_class = np.zeros(classes), np.zeros(classes)
    for r in found:
        n_class[r["class"]], v_class[r["class"]] = r.n, r.v
    N, V = int(n_class.sum()), int(v_class.sum())
    model = train(texts, (n_class + 1) / (N + classes), states=states, classes=classes, iterations=iterations)
    sent = docs.sparkSession.sparkContext.broadcast((model, n_class, v_class))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model, n_class, v_class = sent.value
        place, c, shape = (right.column(k).to_numpy() for k in ("code", "c", "class"))
        known = np.zeros(len(place), np.int64)
        known[place] = c
        of_code = np.zeros(len(place), np.int64)
        of_code[place] = shape
        inside = np.log10(known + 1.0)
        coded = [unpack(b) for b in left.column("codes").to_pylist()]
        flat, ends = np.concatenate(coded), np.cumsum([len(x) for x in coded])[:-1]
        split = lambda of_word: np.split(of_word[flat], ends)
        states_part = log_likelihoods(model, split(of_code)) / np.log(10)
        words_part = split(inside - np.log10(n_class + v_class + 1)[of_code])
        return pa.table({
            "id": left.column("id"), "training": left.column("training"), "n_tokens": pa.array([len(x) for x in coded], pa.int64()),
            "n_known": pa.array([int(x.sum()) for x in split(known > 0)], pa.int64()), "train_tokens": pa.array([N] * len(coded), pa.int64()),
            "base_score": pa.array([float(x.sum()) for x in split(inside - np.log10(N + V + 1.0))], pa.float64()),
            "score": pa.array([float(s + x.sum()) for s, x in zip(states_part, words_part)], pa.float64())})

    counted = words.join(counts.select("word", "c"), "word", "left").select("chunk", "code", "class", F.coalesce("c", F.lit(0)).alias("c"))
    kind, _ = X.id_type(texts)
    return texts.select("chunk", "id", "training", "codes").groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(
        run, f"id {kind}, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""Token ids in seekable zstandard files.

A file is a run of independent zstandard frames of little-endian unsigned 32-bit ids, then one
skippable frame with the documents' ids and lengths (a compressed Arrow stream), then the seek table: a
skippable frame with compressed size, decompressed size and checksum (low 32 bits of the XXH64 of the
decompressed bytes) of every frame. Any zstandard decoder gets all ids; a reader of some documents reads
the tail and decompresses the frames that hold them. A long document spans several frames.

Documents go to files by range of (id, hash of the text), so files in order hold documents in ascending
order. Tasks write under names of their own attempt; the manifest, a Parquet table that Spark commits, says
which files count, so a task that runs again leaves no trace.

Defined cases: null and empty texts are the end id alone; null ids come first; repeated ids stay rows of their own,
ordered by the hash of their text; a special token's string inside a text is that token, as the library has it by default; other columns are ignored; an empty table gives a manifest without rows.
"""

from __future__ import annotations

import io
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm import text as X

# Fixed values of the format: skippable frame, seek table and footer.
INDEX_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

FRAME_IDS = 1 << 16
MEMO_WORDS = 1_500_000
MEMO_BYTES = 96 << 20  # words remembered by one Python worker, counted as their bytes and their ids' bytes and 150 a word
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
GROUP_BYTES = 1 << 23
END_ID = 1


def latin_end(word: str) -> bool:
    """The word ends with an accented Latin letter that the normaliser leaves a letter."""
    last = word[-1:]
    return "\u00c0" <= last < "\u0250" and unicodedata.normalize("NFC", last.lower()).isalpha()


class Encoder:
    """Ids of whole texts as bytes. The tokenizer cuts at blanks and never looks across them, so each word is
    encoded once and remembered; past `memo_words` words, or `memo_bytes` bytes of them and their ids, those not met lately are forgotten."""

    width = 4

    def __init__(self, path: str, memo_words: int = MEMO_WORDS, memo_bytes: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Words met lately, and those met before them that are forgotten next.
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.memo_words, self.memo_bytes, self.held = memo_words, memo_bytes, 0
        #: Tokens that end a word, for cutting the ids of many words apart; none where the vocabulary marks no word ends.
        ends = [t.endswith("</w>") for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda e: e[1])]
        self.ends = np.array(ends) if any(ends) else None
        self.special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}

    def _recall(self, words: set[bytes]) -> list[bytes]:
        """Those that are not remembered; of the others, the ones met before the last are now met lately."""
        again = [w for w in words if w in self.older]
        if again:
            self._remember(again, [self.older.pop(w) for w in again])
            words.difference_update(again)
        return list(words)

    def _remember(self, words: list[bytes], parts: list[bytes]) -> None:
        self.memo.update(zip(words, parts))
        self.held += sum(map(len, words)) + sum(map(len, parts)) + 150 * len(words)

    def _encode(self, new: list[bytes]) -> None:
        """Encodes words, many at a time. Words of letters alone are one piece each, so each ends with the one token that ends a word."""
        rest = new
        if new and self.ends is not None and self.width == Encoder.width:
            text = b" ".join(new).decode().split(" ")
            plain = [t.isalpha() for t in text]
            rest = [w for w, p in zip(new, plain) if not p]
            words, letters = list(compress(new, plain)), list(compress(text, plain))
            for k in range(0, len(letters), 512):
                part = words[k:k + 512]
                ids = np.array(self.tokenizer.encode(" ".join(letters[k:k + 512]), add_special_tokens=False).ids, "<u4")
                cut = np.flatnonzero(self.ends[ids]) + 1
                if len(cut) != len(part):  # letters that the normaliser turns into something else
                    rest += part
                    continue
                packed, at = ids.tobytes(), [0, *(cut * 4).tolist()]
                self._remember(part, [packed[a:b] for a, b in zip(at, at[1:])])
        for k in range(0, len(rest), 4096):
            part = rest[k:k + 4096]
            got = self.tokenizer.encode([w.decode() for w in part], is_pretokenized=True, add_special_tokens=False)
            packed = self.packed(got)
            at = (np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(part) + 1)) * self.width).tolist()
            self._remember(part, [packed[a:b] for a, b in zip(at, at[1:])])

    def packed(self, got) -> bytes:
        """What is remembered of an encoding, `width` bytes a token."""
        return np.array(got.ids, "<u4").tobytes()

    def parts(self, words: list[bytes]) -> list[bytes]:
        """What is remembered of each word, as it stands. New words are learned together."""
        if len(self.memo) > self.memo_words // 2 or self.held > self.memo_bytes // 2:
            self.older, self.memo, self.held = self.memo, {}, 0
        parts = list(map(self.memo.get, words))
        if None in parts:
            holes = [n for n, part in enumerate(parts) if part is None]
            new = self._recall({words[n] for n in holes})
            if new:
                self._encode(new)
            for n in holes:
                parts[n] = self.memo[words[n]]
        return parts

    def encode(self, texts: list[bytes], group_bytes: int = GROUP_BYTES) -> Iterator[bytes]:
        """Ids of each text. Texts of about `group_bytes` bytes are cut into words together, so a word is looked up once for all of them."""
        group, size = [], 0
        for raw in texts:
            if group and size + len(raw) > group_bytes:
                yield from self._joined(group)
                group, size = [], 0
                pa.default_memory_pool().release_unused()  # it would keep several times a group for itself
            group.append(raw)
            size += len(raw)
        if group:
            yield from self._joined(group)
        pa.default_memory_pool().release_unused()

    def _words(self, words: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of distinct words. Case does not count, and ASCII signs behind a letter are tokens of their own: such words share a stem.

        A word that holds a special token's string, in any case, is encoded as it stands: only the string itself is that token.
        """
        low = pc.ascii_lower(words)
        stem = pc.ascii_rtrim(low, characters=SIGNS)
        size, least = pc.binary_length(low).to_numpy(), pc.binary_length(stem).to_numpy()
        signs = (least < size) & (least > 0)
        at = np.flatnonzero(signs)
        ends = np.frombuffer(stem.buffers()[1], np.int64)[stem.offset + 1:][at] - 1 if len(at) else at
        last = np.frombuffer(stem.buffers()[2], np.uint8)[ends] if len(at) else at
        foreign = at[last > 127]
        signs[at] = (last > 96) & (last < 123)
        signs[foreign] = list(map(latin_end, stem.take(pa.array(foreign)).to_pylist()))
        odd = np.zeros(len(words), bool)
        for name in self.special:
            odd |= pc.match_substring(words, name, ignore_case=True).to_numpy(zero_copy_only=False)
        signs &= ~odd
        at = np.flatnonzero(signs)
        tails = [w[n:] for w, n in zip(low.take(pa.array(at)).to_pylist(), pc.utf8_length(stem.take(pa.array(at))).to_pylist())]
        stem = pc.if_else(pa.array(odd), words, pc.if_else(pa.array(signs), stem, low)).dictionary_encode()
        rest = pa.array(tails, pa.large_string()).dictionary_encode()
        parts = self.parts([*stem.dictionary.cast(pa.large_binary()).to_pylist(), *rest.dictionary.cast(pa.large_binary()).to_pylist()])
        # A word without signs behind it takes the empty part at the end.
        n = len(stem.dictionary)
        behind = np.full(len(words), len(parts) - n)
        behind[at] = rest.indices.to_numpy()
        heads, tails = pa.array(parts[:n], pa.large_binary()), pa.array([*parts[n:], b""], pa.large_binary())
        return pc.binary_join_element_wise(heads.take(stem.indices), tails.take(pa.array(behind)), pa.scalar(b"", pa.large_binary()))

    def _joined(self, texts: list[bytes]) -> Iterator[bytes]:
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        found = pc.list_flatten(cut).dictionary_encode()
        # The ids of all words, end to end; a text's begin and end where its words do.
        ids = self._words(found.dictionary).take(found.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64)[np.asarray(cut.offsets)].tolist() if len(ids) else [0] * (len(texts) + 1)
        held = memoryview(data) if data is not None else memoryview(b"")
        return (bytes(held[a:z]) for a, z in zip(ends, ends[1:]))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker; it outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system of a URI such as hdfs://, s3:// or file://; a plain path is a mounted one."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class Writer:
    """Frames, document index and seek table into one open stream."""

    def __init__(self, sink, frame_ids: int = FRAME_IDS, level: int = 3):
        self.sink, self.size, self.pending, self.held = sink, frame_ids * 4, [], 0
        self.packer = zstandard.ZstdCompressor(level=level)
        self.table, self.ids, self.lengths = [], [], []

    def add(self, key, ids: bytes) -> None:
        self.ids.append(key)
        self.lengths.append(len(ids) // 4)
        for k in range(0, len(ids), self.size):
            part = ids[k:k + self.size]
            if self.held and self.held + len(part) > self.size:
                self._flush()
            self.pending.append(part)
            self.held += len(part)

    def _flush(self) -> None:
        plain = b"".join(self.pending)
        packed = self.packer.compress(plain)
        self.sink.write(packed)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.pending, self.held = [], 0

    def close(self, kind: pa.DataType) -> None:
        if self.held:
            self._flush()
        held = io.BytesIO()
        table = pa.table({"id": pa.array(self.ids, kind), "n": pa.array(self.lengths, pa.int64())})
        with pa.ipc.new_stream(held, table.schema) as out:
            out.write_table(table)
        index = self.packer.compress(held.getvalue())
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        entries = b"".join(struct.pack("<III", *e) for e in (*self.table, (len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)))
        footer = struct.pack("<IBI", len(self.table) + 1, CHECKSUMS, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", TABLE_MAGIC, len(entries) + len(footer)) + entries + footer)


class Reader:
    """Documents of one file by place, from the frames that hold them."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != FOOTER_MAGIC:
            raise ValueError("no seek table at the end of the file")
        start = size - 9 - 12 * n
        source.seek(start)
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.plain = np.concatenate([[0], np.cumsum(self.table[:, 1])])
        source.seek(int(self.at[-2]) + 8)
        index = zstandard.decompress(source.read(int(self.table[-1, 0]) - 8))
        found = pa.ipc.open_stream(index).read_all()
        self.ids = found.column("id").to_pylist()
        self.ends = np.cumsum(found.column("n").to_numpy()) if found.num_rows else np.zeros(0, np.int64)
        self.frames_read = 0
        self._last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            self.source.seek(int(self.at[k]))
            plain = zstandard.decompress(self.source.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.frames_read += 1
            self._last = (k, plain)
        return self._last[1]

    def document(self, place: int) -> bytes:
        """Ids of the document at that place in the file, as bytes."""
        end = int(self.ends[place]) * 4
        at = int(self.ends[place - 1]) * 4 if place else 0
        parts = []
        k = int(np.searchsorted(self.plain, at, "right")) - 1
        while at < end:
            plain, base = self.frame(k), int(self.plain[k])
            parts.append(plain[at - base:end - base])
            at, k = base + len(plain), k + 1
        return b"".join(parts)


def write(docs: DataFrame, path: str, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
          frame_ids: int = FRAME_IDS, level: int = 3) -> DataFrame:
    """Write the files under `path` and return the manifest: ordinal, file, n_docs, n_tokens."""
    df = X.pick(docs, id_col, text_col)
    ordered = df.repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    _, kind = X.id_type(df)
    end = int(end_id).to_bytes(4, "little")
    fs, root = open_fs(path)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ordinal = TaskContext.get().partitionId()
        name = f"ids-{ordinal:06d}-{uuid.uuid4().hex}.zst"
        here, folder = open_fs(path)
        out = writer = None
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(X.raw(batch.column(1)))):
                if writer is None:
                    out = here.open_output_stream(f"{folder}/{name}", compression=None)
                    writer = Writer(out, frame_ids, level)
                writer.add(key, ids + end)
        if writer is not None:
            writer.close(kind)
            out.close()
            yield pa.RecordBatch.from_pydict({"ordinal": pa.array([ordinal], pa.int64()), "file": [name],
                                              "n_docs": pa.array([len(writer.ids)], pa.int64()), "n_tokens": pa.array([sum(writer.lengths)], pa.int64())})

    found = ordered.mapInArrow(run, "ordinal long, file string, n_docs long, n_tokens long")
    found.write.mode("overwrite").parquet(f"{path}/manifest")
    return manifest(docs.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str, id_kind: str = "long", *, ids: bool = False) -> DataFrame:
    """id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids (bytes) of every document, from the files.

    A task holds one frame and the index of one file at a time.
    """
    files = manifest(spark, path)
    # One row per file: a running sum over them fits one task.
    before = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"), "ordinal")
    spread = files.repartitionByRange(spark.sparkContext.defaultParallelism * 4, "ordinal").select("file", "base")

    def run(found: Iterable[tuple]) -> Iterator[tuple]:
        fs, root = open_fs(path)
        for name, base in found:
            target = f"{root}/{name.decode()}"
            with fs.open_input_file(target) as source:
                reader = Reader(source, fs.get_file_info(target).size)
                for place, key in enumerate(reader.ids):
                    raw = reader.document(place)
                    start = base + (int(reader.ends[place - 1]) if place else 0)
                    yield (key, start, len(raw) // 4, zlib.crc32(raw), *([raw] if ids else []))

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    fields = [("id", to_arrow_type(_parse_datatype_string(id_kind))), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    kinds = f"id {id_kind}, start long, n_tokens long, ids_crc32 long"
    if ids:
        fields, kinds = [*fields, ("ids", pa.binary())], kinds + ", ids binary"
    return X.map_rows(spread, run, ["file", "base"], kinds, pa.schema(fields), 1024)

import glob
import io
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from cases import odd, odd_texts, prose, table
from tokenizers import Tokenizer

from skyledger.llm import tokenfiles as T
from skyledger.llm.queries import tokenizer_path


def plain(texts):
    t = Tokenizer.from_file(tokenizer_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for x in texts]


def test_word_by_word_ids_are_those_of_the_whole_text():
    texts = [x or "" for x in odd_texts()] + ["don't 'S éa é́ İstanbul ΑΣ Σ", "<|endoftext|> x<|startoftext|>y", "<|endoftext|>", "a<|endoftext|>b<|endoftext|>", "Q<|ENDOFTEXT|>. <|EndOfText|>,", "<|endoftext|>., <|endoftext", "ŉa ßẞ ǅ ﬃ İ K", "​zero width sep", "à ̀b"]
    for memo in (10, 400_000):
        got = list(T.Encoder(tokenizer_path(), memo).encode([x.encode() for x in texts]))
        assert [g + b"\1\0\0\0" for g in got] == plain(texts)


def test_round_trip_over_files(spark, tmp_path):
    texts = odd_texts() + [prose(k, 50) for k in range(200)]
    docs = table(spark, texts).repartition(5)
    path = str(tmp_path / "ids")
    manifest = T.write(docs, path, tokenizer=tokenizer_path(), frame_ids=256)
    expected, start = plain(texts), 0
    rows = sorted(T.read(spark, path, ids=True).collect(), key=lambda r: r.start)
    assert [r.id for r in rows] == list(range(len(texts)))
    for r, raw in zip(rows, expected):
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(raw) // 4, zlib.crc32(raw), raw)
        start += len(raw) // 4
    assert manifest.agg({"n_tokens": "sum"}).first()[0] == start
    # Any zstandard decoder reads the frames; skippable ones hold no ids.
    files = sorted(glob.glob(f"{path}/ids-*.zst"))
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(open(f, "rb"), read_across_frames=True).read() for f in files)
    assert whole == b"".join(expected)


def test_reading_one_document_opens_its_frames_only():
    held = io.BytesIO()
    writer = T.Writer(held, frame_ids=100)
    docs = [np.arange(k * 37 % 90 + 1, dtype="<u4").tobytes() for k in range(300)] + [np.arange(1000, dtype="<u4").tobytes()]
    for k, raw in enumerate(docs):
        writer.add(k, raw)
    writer.close(pa.int64())
    reader = T.Reader(held, len(held.getvalue()))
    assert len(reader.table) > 100 and reader.document(150) == docs[150] and reader.frames_read == 1
    assert reader.document(300) == docs[300] and reader.frames_read <= 13
    assert [reader.document(k) for k in range(301)] == docs
    broken = bytearray(held.getvalue())
    reader.table[3, 2] ^= 1
    with pytest.raises(ValueError):
        reader.frame(3)
    with pytest.raises(ValueError):
        T.Reader(io.BytesIO(bytes(broken[:-1])), len(broken) - 1)


def test_a_task_that_ran_twice_leaves_no_rows(spark, tmp_path):
    path = str(tmp_path / "ids")
    T.write(table(spark, ["a b", "c"]), path, tokenizer=tokenizer_path())
    T.write(table(spark, ["a b", "c"]), path, tokenizer=tokenizer_path())
    assert T.read(spark, path).count() == 2


def test_odd_rows_and_empty_table(spark, tmp_path):
    docs = odd(spark)
    T.write(docs, str(tmp_path / "a"), tokenizer=tokenizer_path())
    rows = sorted(T.read(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    keys = [r.id for r in rows]
    assert len(keys) == docs.count() and keys[0] is None and keys[1:] == sorted(keys[1:])
    T.write(docs.limit(0), str(tmp_path / "b"), tokenizer=tokenizer_path())
    assert T.read(spark, str(tmp_path / "b")).count() == 0


def test_signs_letters_and_small_memories_equal_whole_texts():
    texts = ["don't. 'tis it's' a'' b's. x<|ENDOFTEXT|>! é!? Ü... 日本。 日本! a̸! a≮ !!!a a!!!b 3$ $3$ _a_ -- a_ ǅ. İ. ﬁ! x²! ½. ª' _'s 's! a's!",
             "", " \n ", "x" * 3000 + "$$$", " ".join(f"w{k}%%" for k in range(3000)), "क़. é́. ŉ! ß?!", "$$$ . .. ... a. A. a.. É. é."] + [t or "" for t in odd_texts()]
    whole = Tokenizer.from_file(tokenizer_path())
    due = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for words, size, group in ((1_500_000, 1 << 25, 1 << 23), (50, 1 << 25, 1 << 23), (1_500_000, 200, 64), (1_500_000, 1 << 25, 1)):
        made = T.Encoder(tokenizer_path(), memo_words=words, memo_bytes=size)
        for _ in range(2):
            got = [np.frombuffer(b, "<u4").tolist() for b in made.encode([t.encode() for t in texts], group)]
            assert got == due


def test_what_is_remembered_stays_within_its_bytes():
    made = T.Encoder(tokenizer_path(), memo_bytes=4 << 20)
    texts = [" ".join(f"{'abcdefghij'[k % 10] * 3}{'qrstuvwxyz'[j % 10]}{''.join('klmnopqrst'[int(d)] for d in str(j))}." for j in range(k * 1000, k * 1000 + 1000)) for k in range(120)]
    whole = Tokenizer.from_file(tokenizer_path())
    for n, got in enumerate(made.encode([t.encode() for t in texts], 1 << 14)):
        if n % 40 == 0:
            assert np.frombuffer(got, "<u4").tolist() == whole.encode(texts[n], add_special_tokens=False).ids
        held = [*made.memo.items(), *getattr(made, "older", {}).items()]
        assert sum(sys.getsizeof(w) + sys.getsizeof(p) for w, p in held) < 5 << 20

import hashlib

import numpy as np
import pytest
from cases import odd, odd_texts, prose, table
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyledger.llm import bpe
from skyledger.llm.queries import tokenizer_path

HARD = ["<|endoftext|> hi", "hi<|endoftext|>", "a<|endoftext|>b<|endoftext|><|startoftext|>", "<|endoftext", "don't 'S éa é́ İstanbul ΑΣ Σ",
        "aaaaaaa aaa aaaa aaaaaaaaaaaaa", "\xa0　x", "à ̀b", "'ll 'LL''''", "x" * 3000, "👩‍👩‍👧 ﬃ ǅ", "\x85a\x1cb", "\0", "ababab abababa", "a.,a., a.,"]


def plain(texts, name="word_bpe_49k.json"):
    """(ids, decoded text) by the library, text by text."""
    t = Tokenizer.from_file(tokenizer_path(name))
    found = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    return [(ids, t.decode(ids, skip_special_tokens=False)) for ids in found]


def one_at_a_time(merges, word):
    """Merging by the definition: the lowest rank, leftmost first, one pair at a time."""
    word = list(word)
    while True:
        ranks = [(merges[pair], k) for k, pair in enumerate(zip(word, word[1:])) if pair in merges]
        if not ranks:
            return word
        _, k = min(ranks)
        word[k:k + 2] = ["".join(word[k:k + 2])]


@given(st.lists(st.text("abc", min_size=1, max_size=40), min_size=1, max_size=12, unique=True))
@settings(max_examples=150, deadline=None)
def test_index_merges_like_one_pair_at_a_time(pieces):
    pairs = [("a", "b"), ("a", "a"), ("ab", "ab"), ("aa", "aa"), ("c", "ab"), ("abab", "ab"), ("aaaa", "aa"), ("b", "b"), ("cab", "bb")]
    vocab = {t: k for k, t in enumerate(["a", "b", "c", *["".join(p) for p in pairs]])}
    ids, ends = bpe.Merger({"vocab": vocab, "merges": pairs}).merge(pieces)
    got = np.split(ids, ends[:-1])
    ranks = {p: k for k, p in enumerate(pairs)}
    assert [g.tolist() for g in got] == [[vocab[t] for t in one_at_a_time(ranks, p)] for p in pieces]


def test_a_vocabulary_out_of_order_is_refused():
    with pytest.raises(ValueError):
        bpe.Merger({"vocab": {"a": 0, "b": 1, "ab": 2, "abb": 3}, "merges": [("ab", "b"), ("a", "b")]})


@pytest.mark.parametrize("name, by_word", [("word_bpe_49k.json", True), ("word_bpe_49k.json", False), ("byte_bpe_50k.json", False)])
def test_ids_and_texts_are_the_library_s(name, by_word):
    texts = [x or "" for x in odd_texts()] + HARD
    for memory in (0, 1 << 28):
        codec = bpe.Codec(tokenizer_path(name), by_word=by_word, memory_bytes=memory)
        for again in range(2):
            got = [np.frombuffer(i, "<u4").tolist() for i in codec.encode([x.encode() for x in texts])]
            assert [(g, codec.decode(np.array(g, "<u4").tobytes()).decode()) for g in got] == plain(texts, name)


def test_digests_in_slices():
    codec = bpe.Codec(tokenizer_path())
    [ids] = codec.encode([prose(4, 400).encode()])
    assert codec.digest(ids, 40) == codec.digest(ids)


def test_encode_decode_and_digests(spark):
    docs = odd(spark)
    path = tokenizer_path()
    expected = sorted(((r.doc_id, *x) for r, x in zip(docs.collect(), plain([r.text for r in docs.collect()]))), key=str)
    encoded = bpe.encode(docs, tokenizer=path)
    assert sorted(((r.id, r.ids) for r in encoded.collect()), key=str) == sorted(((k, i) for k, i, _ in expected), key=str)
    assert sorted(((r.id, r.text) for r in bpe.decode(encoded, tokenizer=path).collect()), key=str) == sorted(((k, t) for k, _, t in expected), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = bpe.round_trip(docs, tokenizer=path).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((k, len(i), sha(" ".join(map(str, i))), sha(t)) for k, i, t in expected), key=str)


def test_null_ids_decode_to_nothing_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None), (None, [])], "id long, ids array<int>")
    assert {tuple(r) for r in bpe.decode(rows, tokenizer=tokenizer_path()).collect()} == {(1, ""), (None, "")}
    empty = table(spark, [])
    assert bpe.round_trip(empty, tokenizer=tokenizer_path()).count() == bpe.encode(empty, tokenizer=tokenizer_path()).count() == 0


def test_words_are_looked_up_once_a_block_and_lately_used_ones_stay():
    """A memory that is full lets go of the words not met lately, not of all; a block asks for each distinct word once."""
    codec = bpe.Codec(tokenizer_path(), memory_bytes=2 * 400 * 150)
    learned, learn = [], codec._learn
    codec._learn = lambda raws: learned.extend(raws) or learn(raws)
    common = prose(5, 300)
    for k in range(6):
        texts = [f"{common} {prose(k, 3)} {' '.join(f'word{k}x{j}' for j in range(300))}", " ", common * 2]
        got = [np.frombuffer(i, "<u4").tolist() for i in codec.encode([x.encode() for x in texts])]
        assert got == [ids for ids, _ in plain(texts)]
    assert max(learned.count(w.encode()) for w in common.split()) == 1 and len(codec.memory) + len(codec.older) < 1300

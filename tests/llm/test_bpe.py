"""The word tokenizer's merges in rounds against the library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from matforge.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Codec(f.read())


def odd_texts(n, seed=5):
    rnd = random.Random(seed)
    letters = list("abcdefghijklmnopqrstuvwxyzABCXYZ0123456789 '.,;!?-<|>") + ["'s", "'LL", " ", "\t", "\n", "é", "É", "ß", "İ", "Σ", "σ", "ς", "é", "H̱", "ﬁ", "中", "😀", " ", "\u0085", " ", "\x1c", "\x00", "½", "٣", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>"]
    return ["".join(rnd.choices(letters, k=rnd.randrange(0, 60))) for _ in range(n)]


def same(codec, library, texts):
    got = codec.encode(texts)
    for t, ids in zip(texts, got):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids == want, t[:80]
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_odd_texts(codec, library):
    same(codec, library, ["", " ", "\n\t", "Hello, world's end", "aaa aaaa aaaaa aaaaaa", "ΑΣ ΣΑΣ", *odd_texts(4000)])


def test_long_words(codec, library):
    rnd = random.Random(1)
    words = ["a" * 5001, "ab" * 4000, "".join(rnd.choices("etaoinshrdlu", k=20_000)), "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=5000)), "é" * 4097, "." * 6000, "7" * 5000, "x" * 4096, "x" * 4095]
    same(codec, library, words)
    same(codec, library, [" ".join(words) * 2])


def test_both_ways_of_merging_agree(codec):
    rnd = random.Random(2)
    for k in (1, 2, 3, 50, 900):
        w = "".join(rnd.choices("etaoins", k=k)).encode()
        assert codec.merges._by_rank(codec.merges._symbols([w])).astype("<u4").tobytes() == codec.merges.encode([w])[0]


def test_bounded_memory_of_words(library):
    with open(PATH, encoding="utf-8") as f:
        small = bpe.Codec(f.read(), keep=50)
    for part in range(10):
        same(small, library, odd_texts(40, seed=part))
        assert len(small.pieces) <= 2000


def test_rows(spark, library):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (None, None, "y"), (3, "", "z"), (4, "w " * 30_000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in bpe.round_trip(df, PATH).collect())
    assert got == sorted((str(i), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    back = bpe.decode_ids(bpe.encode_texts(df, PATH), PATH)
    assert back.columns == ["doc_id", "text", "ids", "decoded"]  # the clashing column is replaced
    for r in back.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.round_trip(df.limit(0), PATH).count() == 0

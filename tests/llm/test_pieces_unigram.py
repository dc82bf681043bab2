"""Streaming Viterbi by scores, with a unigram model written by hand, against the library and a plain search."""

import random
import struct

import sentencepiece

from matforge.llm import pieces


def field(number, data):
    return bytes([number << 3 | 2, *varint(len(data))]) + data


def varint(n):
    out = []
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return [*out, n]


def unigram_model(scores):
    """A model file: pieces with scores, unigram, no normalisation."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(p, s, 1) for p, s in scores.items()]
    proto = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([k])) for p, s, k in rows)
    proto += field(2, b"\x18\x01")  # trainer: model_type unigram
    return proto + field(3, field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01")  # prefix space, nothing removed


def model(seed):
    r = random.Random(seed)
    names = {"▁", "a", "b", "c"} | {"".join(r.choice("abc") for _ in range(r.randint(2, 6))) for _ in range(60)} | {"▁" + "".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(40)}
    return {p: -r.random() * 10 - len(p) for p in sorted(names)}


def best_path(v, text):
    best = [(0.0, 0)] + [(-1e99, 0)] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - v.longest), end):
            s = v.score.get(text[begin:end], v.least if begin == end - 1 else None)
            if s is not None and best[begin][0] + s > best[end][0]:
                best[end] = best[begin][0] + s, begin
    out, at = [], len(text)
    while at:
        out.append(text[best[at][1] : at])
        at = best[at][1]
    return out[::-1]


def test_unigram_as_in_the_library():
    for seed in range(4):
        proto = unigram_model(model(seed))
        sp, codec, r = sentencepiece.SentencePieceProcessor(model_proto=proto), pieces.Codec(proto), random.Random(seed + 50)
        assert codec.v.unigram
        for n in (1, 3, 20, 400):
            for _ in range(20):
                text = "".join(r.choice("abc abc") for _ in range(n)).strip() or "a"
                assert codec.encode(text) == sp.encode(text), text
                assert codec.decode(codec.encode(text)) == text


def test_long_stream_stays_bounded():
    codec, r = pieces.Codec(unigram_model(model(9))), random.Random(1)
    text = "▁" + "".join(r.choice("abc") for _ in range(4000))
    stream, out, widest = pieces.Stream(codec.v, codec.rules), [], 0
    for c in text:
        out += stream.feed(c)
        widest = max(widest, len(stream.text))
    assert out + stream.finish() == best_path(codec.v, text) and widest < 60 * codec.v.longest

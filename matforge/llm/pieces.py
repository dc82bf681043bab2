"""Encoding and decoding with a public SentencePiece model by streaming Viterbi.

The path search runs over pieces: every position keeps the best path that ends there, by its score and the piece it ends with,
which points back to where that begins.  Only the positions of a window, as long as the longest piece, can still be extended;
whenever the backpointers of all of them lead through one boundary, ids up to it are committed and forgotten.

Scores are the model's.  In a unigram model a path's score is the sum of its pieces' scores, and several paths survive.  In a
merge (BPE) model scores order the merges and do not add up: what they decide is which pieces may follow each other.  Two
neighbours may if merging their joined text, best score first, gives these two again, and a piece may stand if merging its text
gives it alone; a transition that may not is worth minus infinity, all others nothing.  The best path is the library's own
encoding in either case.  Characters without a piece become byte pieces.

No piece crosses a space or a character outside the vocabulary: there all paths meet, and a stream begins anew.  What lies
between two such places is kept with its ids, up to a bounded number, since most words come again.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import many_objects, single_threaded, texts_of, with_columns

SPACE = "▁"


class Vocabulary:
    """The pieces of a SentencePiece model, merge or unigram."""

    def __init__(self, model_proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model_proto)
        self.unigram = model_type(model_proto) == UNIGRAM
        self.piece = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(len(self.piece))]
        self.unknown = sp.unk_id()
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(len(self.piece)) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.id = {p: i for i, p in enumerate(self.piece) if not special[i] and i not in self.byte_of}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.special = {i for i, s in enumerate(special) if s}
        self.longest = max(map(len, self.id))
        self.letters = {c for p in self.id for c in p}
        self.trie: dict = {}  # by character; a node where a piece ends holds it under the empty text
        for p in self.id:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.inside = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}  # neighbours that some piece joins
        self.least = min(self.score.values()) - 10.0  # of a character without a piece, in a unigram model
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece goes on after a space")

    def merged(self, text: str) -> list[str]:
        """Merging in order of score, leftmost first: the definition, for short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def ids(self, p: str) -> list[int]:
        """Ids of one piece, or of a character without one."""
        i = self.id.get(p)
        if i is not None:
            return [i]
        return [self.byte[b] for b in p.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]


UNIGRAM = 1


def model_type(proto: bytes) -> int:
    """The model type that the trainer's settings name (field 3 of field 2 of the file): 1 unigram, the default; 2 merge."""

    def fields(data: bytes):
        at = 0

        def number() -> int:
            nonlocal at
            x = shift = 0
            while True:
                b = data[at]
                at += 1
                x |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return x

        while at < len(data):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            else:
                n = {1: 8, 5: 4}.get(tag & 7) or number()
                yield tag >> 3, data[at : at + n]
                at += n

    spec = next((v for k, v in fields(proto) if k == 2), b"")
    return next((v for k, v in fields(spec) if k == 3), UNIGRAM)


class Transitions:
    """Which pieces may follow each other in a merge model; what is known is kept, up to a bound."""

    def __init__(self, v: Vocabulary, keep: int = 1_200_000):
        self.v, self.keep = v, keep
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}

    def follows(self, a: str, b: str) -> bool:
        if len(self.pairs) > self.keep:
            self.pairs.clear()
        got = self.pairs[a, b] = not a or self.v.merged(a + b) == [a, b]
        return got

    def stands(self, p: str) -> bool:
        if len(self.alone) > self.keep:
            self.alone.clear()
        got = self.alone[p] = len(p) == 1 or p in self.v.id and self.v.merged(p) == [p]
        return got


class Stream:
    """Viterbi over characters as they come; ``feed`` and ``finish`` give pieces as they are settled."""

    def __init__(self, v: Vocabulary, rules: Transitions):
        self.v, self.rules = v, rules
        self.text, self.end = "", 0  # the window, and how much of it is searched
        self.last, self.total = [""], [0.0]  # by place in the window: the piece that ends there, and the score of its path
        self.live = [(0, v.trie)]  # places from which a piece goes on, and how far it is spelled
        self.check = 2 * v.longest

    def feed(self, chars: str) -> list[str]:
        v, rules, last, total = self.v, self.rules, self.last, self.total
        pairs, alone, unigram, settled = rules.pairs.get, rules.alone.get, v.unigram, []
        self.text += chars
        while self.end < len(self.text):
            text, live, end = self.text, self.live, self.end
            for end in range(self.end + 1, len(text) + 1):
                c = text[end - 1]
                best, score, still = None, 0.0, []
                for begin, node in live:
                    node = node.get(c)
                    if node is None:
                        if begin < end - 1 or best is not None and not unigram:
                            continue  # no piece is spelled so
                        p = c  # a character without a piece stands for itself
                    else:
                        still.append((begin, node))
                        p = node.get("")
                        if p is None:
                            continue
                    if unigram:
                        s = total[begin] + v.score.get(p, v.least)
                        if best is None or s > score:
                            best, score = p, s
                    elif best is None:  # others that may stand here are worth no more
                        ok = alone(p)
                        if ok or ok is None and rules.stands(p):
                            before = last[begin]
                            ok = pairs((before, p))
                            if ok or ok is None and rules.follows(before, p):
                                best = p
                if best is None:
                    raise ValueError("no piece ends here")  # cannot happen: one does in the merged text
                last.append(best)
                total.append(score)
                still.append((end, v.trie))
                live = still
                if end >= self.check:
                    break
            self.live, self.end = live, end
            if end >= self.check:
                settled += self._settle()
        return settled

    def _settle(self) -> list[str]:
        """Pieces before the last boundary that the paths of all live places share."""
        shared = None
        for pos, _ in self.live:
            path = {pos}
            while pos > 0:
                pos -= len(self.last[pos])
                path.add(pos)
            shared = path if shared is None else shared & path
        out = self._commit(max(shared))
        self.check = self.end + self.v.longest  # looks again after as many characters
        return out

    def _commit(self, upto: int) -> list[str]:
        out, pos = [], upto
        while pos > 0:
            out.append(self.last[pos])
            pos -= len(self.last[pos])
        self.text, self.end = self.text[upto:], self.end - upto
        self.live = [(b - upto, node) for b, node in self.live]
        del self.last[:upto], self.total[:upto]
        out.reverse()
        return out

    def finish(self) -> list[str]:
        return self._commit(self.end)


class Codec(dict):
    """Ids of the parts of texts, as little-endian 32-bit numbers: a part that is not there is encoded, and kept if it is short.

    When ``keep`` are, they become the older half, from which parts that come again return.
    """

    def __init__(self, model_proto: bytes, keep: int = 500_000, longest: int = 200):
        super().__init__()
        single_threaded()
        many_objects()
        self.v, self.keep, self.longest = Vocabulary(model_proto), keep, longest
        self.rules, self.older = Transitions(self.v), {}
        # parts between boundaries: spaces begin one, a character without a piece is one
        inner = "".join(re.escape(c) for c in sorted(self.v.letters - {SPACE}))
        self.parts = re.compile(f"{SPACE}+[{inner}]*|[{inner}]+|[^{SPACE}{inner}]", re.S).findall
        # what an id shows; bytes beyond ASCII need their neighbours
        self.shown = ["" if i in self.v.special else p.replace(SPACE, " ") for i, p in enumerate(self.v.piece)]
        for b, i in self.v.byte.items():
            self.shown[i] = chr(b) if b < 128 else None

    def __missing__(self, part: str) -> bytes:
        got = self.older.get(part)
        if got is None:
            cut = [i for i in range(1, len(part)) if part[i - 1 : i + 1] not in self.v.inside] if len(part) <= self.longest else []
            if cut:  # no piece joins these neighbours: all paths meet between them
                got = b"".join([self[part[i:j]] for i, j in zip([0, *cut], [*cut, len(part)])])
            else:
                stream = Stream(self.v, self.rules)
                ids = [i for p in stream.feed(part) + stream.finish() for i in self.v.ids(p)]
                got = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= self.longest:
            if len(self) >= self.keep:
                self.older = dict(self)
                self.clear()
            self[part] = got
        return got

    def raw(self, text: str) -> bytes:
        """Ids of a text, four bytes each; the empty text has none."""
        return b"".join(map(self.__getitem__, self.parts(SPACE + text.replace(" ", SPACE)))) if text else b""

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.raw(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters, control ids nothing."""
        try:
            return "".join(map(self.shown.__getitem__, ids)).removeprefix(" ")
        except TypeError:  # bytes are among them
            pass
        v, out, raw = self.v, [], bytearray()
        for i in ids:
            if self.shown[i] is None:
                raw.append(v.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.shown[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).removeprefix(" ")


_codecs: dict[int, Codec] = {}


def codec_of(model_proto: bytes) -> Codec:
    """One codec for each model in a worker: what it has learned serves the worker's next tasks."""
    key = zlib.crc32(model_proto)
    if key not in _codecs:
        _codecs[key] = Codec(model_proto)
    return _codecs[key]


def encode_texts(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the array column ``ids``: whole texts encoded.  Null and empty texts have no ids.

    Rows are encoded one by one: ties and repeated rows are no special case.  A column named like ``ids`` is replaced.
    """
    with open(model_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: of fixed size

    def make():
        codec = codec_of(shipped.value)
        return lambda batch: {ids: [codec.encode(t) for t in texts_of(batch, text)]}

    return with_columns(docs, f"`{ids}` array<int>", make, rows=128)


def decode_ids(docs: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the column ``decoded``: the text of ``ids``; null ids give an empty text."""
    with open(model_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        codec = codec_of(shipped.value)
        return lambda batch: {text: [codec.decode(x or []) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]}

    return with_columns(docs, f"`{text}` string", make, rows=128)


def round_trip(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, n_ids, ids_crc32`` (of little-endian unsigned 32-bit ids) and whether the ids decode to the text.

    One row for each row of ``docs``, repeated and null ids among them; null and empty texts have no ids and decode to nothing.
    Other columns are ignored."""
    with open(model_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        codec = codec_of(shipped.value)

        def work(batch: pa.RecordBatch) -> dict:
            out: dict = {"n_chars": [], "n_ids": [], "ids_crc32": [], "round_trip": []}
            for t in texts_of(batch, "_t"):
                raw = codec.raw(t)
                out["n_chars"].append(len(t))
                out["n_ids"].append(len(raw) // 4)
                out["ids_crc32"].append(zlib.crc32(raw))
                out["round_trip"].append(codec.decode(np.frombuffer(raw, "<u4").tolist()) == t.replace(SPACE, " "))
            return out

        return work

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("_t"))
    return with_columns(rows, "n_chars long, n_ids long, ids_crc32 long, round_trip boolean", make, rows=128).drop("_t")

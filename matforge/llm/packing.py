"""Harmonic packing of token sequences.

A document longer than the capacity gives full sequences first; its rest, and every shorter document, falls into a class by its
length: class ``k`` holds lengths in (capacity / (k + 1), capacity / k], and the last class all shorter ones.  A bin of class
``k`` takes exactly ``k`` documents, which always fit.  The room that such a bin leaves is filled by the next documents that
come, the last of them cut to fit; what remains of that one is classed by its own length.  Bins of the last class
take documents until they are full and cut the last one.  So every bin is full, and a bin cuts one document at most.

Bins of different classes never mix, and each worker fills its own: no shuffle.  The documents that a worker has left at its
end are laid end to end into full sequences; only the last, shorter stretch becomes sequences of powers of two, which need no
padding.  A class holds less than ``capacity`` tokens open, so a worker holds less than ``CLASSES * capacity`` tokens, one
document, and what goes out next (about ``FLUSH`` tokens).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import many_objects, single_threaded, texts_of

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
FLUSH = 1 << 20
CLASSES = 64


class WordEncoder(dict):
    """Ids of words by a public tokenizer that never joins across ASCII white space: word to little-endian 32-bit numbers.

    A word that is not there is encoded and kept.  When ``keep`` are, they become the older half, from which words that come
    again return; what does not come again goes at the next turn.  A word is its lower-cased body and a tail of punctuation:
    the tokenizer lower-cases and cuts between letters or digits and other characters, so both are encoded apart.  Words that
    may hold a special token stay as they are.
    """

    TAIL = b".,!*#$%&|"
    ENDS = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")

    def __init__(self, tokenizer_json: str, keep: int = 300_000):
        super().__init__()
        single_threaded()
        many_objects()
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_str(tokenizer_json), keep
        self.older: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {}
        self.merge = self.tokenizer.model.tokenize
        self.letters = regex.compile(r"\p{L}+").fullmatch
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: these stand for themselves
        self.bytes = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(shown)))}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.keep:
            self.older = dict(self)
            self.clear()
            self.tails.clear()
        got = self.older.get(word)
        if got is None:
            got = self._ids(word)
        self[word] = got
        return got

    def _ids(self, word: bytes) -> bytes:
        if b"<|" in word:
            return self._whole(word)
        low = word.lower()
        body = low.rstrip(self.TAIL)
        if body == word or not body or body[-1] not in self.ENDS:
            return self._part(low)
        tail = low[len(body) :]
        if not tail:
            return self[body]
        after = self.tails.get(tail)
        if after is None:
            after = self.tails[tail] = self._part(tail)
        return self[body] + after

    def _part(self, part: bytes) -> bytes:
        """Words of lower-case letters go straight to the merge model, others through the whole tokenizer."""
        if part.isalpha() and part.isascii():
            return _raw([t.id for t in self.merge(part.decode("ascii"))])
        w = part.decode("utf-8", "replace")
        if w.isalpha() and w.islower() and self.letters(w) and is_normalized("NFC", w):
            return _raw([t.id for t in self.merge(part.decode("latin-1").translate(self.bytes))])
        return self._whole(part)

    def _whole(self, word: bytes) -> bytes:
        return _raw(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts."""
        get = self.__getitem__
        return [b"".join(map(get, t.encode("utf-8", "surrogatepass").split())) for t in texts]


def _raw(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[int, WordEncoder] = {}


def encoder_of(tokenizer_json: str) -> WordEncoder:
    """One encoder for each tokenizer in a worker: the words that it has met serve the worker's next tasks."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _encoders:
        _encoders[key] = WordEncoder(tokenizer_json)
    return _encoders[key]


def class_of(length: int, capacity: int, classes: int = CLASSES) -> int:
    """The harmonic class of a length from 1 to ``capacity``: how many of its kind a bin takes."""
    return min(capacity // length, classes)


class Piece(NamedTuple):
    doc: object
    start: int
    length: int
    raw: bytes  # its ids
    size: int  # tokens of the whole document

    def part(self, at: int, n: int) -> Piece:
        return Piece(self.doc, self.start + at, n, self.raw[4 * at : 4 * (at + n)], self.size)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        """The first ``n`` tokens and the rest."""
        return self.part(0, n), self.part(n, self.length - n)


class Bins:
    """The open bins of one worker, one for each class.  ``add`` and ``rest`` give full sequences as lists of pieces."""

    def __init__(self, capacity: int, classes: int = CLASSES):
        if capacity & (capacity - 1):
            raise ValueError("the capacity must be a power of two")
        self.capacity, self.classes = capacity, classes
        self.open: dict[int, list[Piece]] = {}
        self.room: dict[int, int] = {}  # of the open bins
        self.waiting: list[int] = []  # classes whose bin has all its documents and wants a filling

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Takes a document, or what is left of one."""
        if piece.length >= self.capacity:
            at = piece.length // self.capacity * self.capacity
            for i in range(0, at, self.capacity):
                yield [piece.part(i, self.capacity)]
            piece = piece.part(at, piece.length - at)
        while piece.length and self.waiting:  # fills the room of a bin that has its number of documents
            k = self.waiting[-1]
            n = min(self.room[k], piece.length)
            part, piece = piece.cut(n)
            self.open[k].append(part)
            self.room[k] -= n
            if not self.room[k]:
                self.waiting.pop()
                yield self._close(k)
        if piece.length:
            yield from self._classed(piece)

    def _classed(self, piece: Piece) -> Iterator[list[Piece]]:
        k = class_of(piece.length, self.capacity, self.classes)
        held = self.open.setdefault(k, [])
        room = self.room.setdefault(k, self.capacity)
        if k == self.classes and piece.length > room:  # the last class: until the bin is full
            part, piece = piece.cut(room)
            held.append(part)
            self.room[k] = 0
            yield self._close(k)
            yield from self._classed(piece)
            return
        held.append(piece)
        self.room[k] = room - piece.length
        if not self.room[k]:
            yield self._close(k)
        elif len(held) == k < self.classes:
            self.waiting.append(k)

    def _close(self, k: int) -> list[Piece]:
        self.room.pop(k)
        return self.open.pop(k)

    def rest(self) -> Iterator[list[Piece]]:
        """What stayed open: full sequences, and powers of two of the last stretch."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        total = sum(p.length for p in left)
        self.open.clear(), self.room.clear(), self.waiting.clear()
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in range(self.capacity.bit_length() - 2, -1, -1) if total % self.capacity >> b & 1]
        left.reverse()
        for size in sizes:
            held: list[Piece] = []
            while size:
                piece = left.pop()
                part, more = piece.cut(min(size, piece.length))
                held.append(part)
                size -= part.length
                if more.length:
                    left.append(more)
            yield held


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are the piece's tokens: a sequence is its pieces' ids in the order of ``offset``.

    A document is its text's ids and then ``end_id``; a null or empty text is that id alone.  Repeated rows and ids are packed
    as documents of their own; a null ``doc_id`` is kept.  An empty table gives no rows.  Other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = sc.broadcast(f.read())  # a vocabulary file: its size does not depend on the input
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    kind = pa.schema([(n, pa.int64()) for n in names] + [("ids", pa.list_(pa.int32()))])

    def batch(held: list[list[Piece]], first: int) -> pa.RecordBatch:
        """Sequences, numbered from ``first`` on, as rows."""
        pieces = [p for seq in held for p in seq]
        raws = [p.raw for p in pieces]
        lengths = np.array([p.length for p in pieces], np.int64)
        sizes = np.array([len(seq) for seq in held], np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        begin = np.repeat(np.cumsum(np.concatenate([[0], sizes[:-1]])), sizes) if len(held) else np.zeros(0, np.int64)
        numbers = np.repeat(first + np.arange(len(held)), sizes)
        whole = lambda c: pa.array(c, pa.int64())
        cols = [whole([p.doc for p in pieces]), whole([p.start for p in pieces]), whole(lengths), whole([zlib.crc32(r) for r in raws]), whole([p.size for p in pieces]), whole(numbers), whole(ends[:-1] - ends[begin])]
        flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(raws))])
        return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins, ready = encoder_of(shipped.value).texts, Bins(capacity), []
        number = TaskContext.get().partitionId() << 40
        end = struct.pack("<I", end_id)
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                b = big.slice(lo, 256)
                for key, raw in zip(b.column(0).to_pylist(), encode(texts_of(b, "t"))):
                    raw += end
                    for full in bins.add(Piece(key, 0, len(raw) // 4, raw, len(raw) // 4)):
                        ready.append(full)
                        if len(ready) * capacity > FLUSH:
                            yield batch(ready, number)
                            number += len(ready)
                            ready = []
        for seq in bins.rest():
            ready.append(seq)
            if len(ready) > FLUSH // capacity:
                yield batch(ready, number)
                number += len(ready)
                ready = []
        yield batch(ready, number)

    return docs.select(docs[doc_id].cast("long").alias("d"), docs[text].alias("t")).mapInArrow(run, SCHEMA)

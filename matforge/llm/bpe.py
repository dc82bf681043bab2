"""Byte-pair encoding and decoding by rounds of merges over many words at once.

The symbols of all new words of a batch lie in one flat array.  A pair of neighbours is one number, and its rank is found by
binary search in the sorted numbers of all pairs that merge.  In each round every word merges its pair of lowest rank,
wherever it stands, from left to right; words without such a pair are done and leave the array.  A merge makes pairs of higher
rank only, so a round is what the library does one merge at a time.

A word of many thousand letters would need thousands of rounds over all its symbols.  Such a word is merged rank by rank
instead: its pairs are filed under their ranks, and a round touches the pairs of the lowest rank only.

Words that were met are kept with their ids, up to a bounded number.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import many_objects, single_threaded, texts_of, with_columns

NONE = np.iinfo(np.int64).max  # the rank of a pair that does not merge
LONG_WORD = 4096  # symbols from which on a word is merged rank by rank


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges:
    """Pairs that merge, sorted by their number, with rank and result."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[alphabet[b] + end] for b in range(256)], np.int64)
        self.base = max(vocab.values()) + 1
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        made = np.full(self.base, -1, np.int64)  # by symbol: the rank of the merge that makes it
        made[self.result] = np.arange(len(pairs))
        if len(np.unique(self.result)) != len(pairs) or (np.maximum(made[left], made[right]) >= np.arange(len(pairs))).any():
            raise ValueError("merges must make each symbol once, and before it is used")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of words (not empty), as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) < LONG_WORD]
        for i, w in enumerate(words):
            if len(w) >= LONG_WORD:
                out[i] = self._by_rank(self._symbols([w])).astype("<u4").tobytes()
        if short:
            self._rounds([words[i] for i in short], short, out)
        return out

    def _symbols(self, words: list[bytes]) -> np.ndarray:
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words]) - 1
        symbols = self.inner[flat]
        symbols[ends] = self.last[flat[ends]]
        return symbols

    def _rounds(self, words: list[bytes], place: list[int], out: list[bytes]) -> None:
        symbol = self._symbols(words)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank = np.full(len(symbol), NONE)  # of the pair that begins at a symbol
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self.ranks(symbol[inside], symbol[inside + 1])
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            least = np.minimum.reduceat(rank, starts)
            done = least == NONE
            if done.any():
                raw = symbol.astype("<u4").tobytes()
                for s, n, w in zip(starts[done].tolist(), sizes[done].tolist(), word[starts[done]].tolist()):
                    out[place[w]] = raw[4 * s : 4 * (s + n)]
                live = np.repeat(~done, sizes)
                symbol, word, rank = symbol[live], word[live], rank[live]
                least, sizes = least[~done], sizes[~done]
                if not len(symbol):
                    return
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            # of pairs that overlap (as in "aaa"), every second one of a run merges, from its first on
            fresh = np.r_[True, hit[1:] != hit[:-1] + 1]
            run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbol[hit] = self.result[rank[hit]]
            gone = np.ones(len(symbol), bool)
            gone[hit + 1] = False
            moved = (np.cumsum(gone) - 1)[hit]
            symbol, word, rank = symbol[gone], word[gone], rank[gone]
            near = np.unique(np.r_[moved, np.maximum(moved - 1, 0)])
            nxt = np.minimum(near + 1, len(symbol) - 1)
            joined = (nxt > near) & (word[nxt] == word[near])
            rank[near] = np.where(joined, self.ranks(symbol[near], symbol[nxt]), NONE)

    def _by_rank(self, symbol: np.ndarray) -> np.ndarray:
        """One long word: a heap of ranks, each with the places of its pairs."""
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        rank = np.full(n, NONE)
        rank[:-1] = self.ranks(symbol[:-1], symbol[1:])
        filed: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(at: np.ndarray) -> None:
            at = at[rank[at] != NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1) if len(at) else []:
                r = int(rank[part[0]])
                if r not in filed:
                    filed[r] = []
                    heapq.heappush(heap, r)
                filed[r].append(part)

        file(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(filed.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            fresh = np.r_[True, at[1:] != after[at[:-1]]]
            run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            lost = after[at]
            symbol[at] = self.result[r]
            alive[lost] = False
            after[at] = after[lost]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            near = np.unique(np.r_[at, before[at][before[at] >= 0]])
            ends = after[near] >= n
            rank[near] = np.where(ends, NONE, self.ranks(symbol[near], symbol[np.where(ends, 0, after[near])]))
            file(near)
        return symbol[alive]


class Codec:
    """A public byte-level word tokenizer: its normalization and word pattern by the library, its merges by ``Merges``.

    ``keep`` bounds the words kept with their ids; beyond it only those of the texts at hand stay.
    """

    #: The tokenizer's word pattern over lower-case ASCII.
    ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")

    def __init__(self, tokenizer_json: str, keep: int = 400_000):
        single_threaded()
        many_objects()
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        library = Tokenizer.from_str(tokenizer_json)
        self.normalize, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.byte_of = {c: b for b, c in byte_alphabet().items()}
        self.merges, self.keep = Merges(spec["model"]), keep
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        marks = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.marks = re.compile(f"({marks})") if marks else None
        self.shown = [""] * (max([self.merges.base - 1, *self.special.values()]) + 1)
        for token, i in [*spec["model"]["vocab"].items(), *self.special.items()]:
            self.shown[i] = token
        self.digits = [str(i) for i in range(len(self.shown))]
        self.pieces: dict[bytes, bytes] = {}  # by piece of the word pattern
        self.words: dict[bytes, bytes] = {}  # by word between ASCII spaces, with characters beyond ASCII or a special token
        # white space of the library's pattern may be wider than Python's: such control characters take the whole way
        self.odd = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]").search

    def _whole(self, word: str) -> list[bytes | int]:
        """Pieces and special ids of a word, by the library's own rules."""
        out: list[bytes | int] = []
        for part in self.marks.split(word) if self.marks else [word]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [bytes(map(self.byte_of.__getitem__, p)) for p, _ in self.cut(self.normalize(part))]
        return out

    def _pieces(self, word: bytes) -> list[bytes | int]:
        if self._simple(word):
            return self.ASCII.findall(word.lower())
        return self._whole(word.decode("utf-8", "replace"))

    def _simple(self, data: bytes) -> bool:
        return data.isascii() and b"<|" not in data and not self.odd(data)

    def _room(self, known: dict[bytes, bytes], needed: set[bytes]) -> dict[bytes, bytes]:
        """``known``, or only what is needed now, if both would be too many."""
        if len(known) + len(needed) <= self.keep:
            return known
        return {w: known[w] for w in needed if w in known}

    def raw(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, four bytes each.  All words that are new in ``texts`` are merged together."""
        held: list[tuple[bool, list[bytes]]] = []
        for t in texts:
            data = t.encode("utf-8", "surrogatepass")
            simple = self._simple(data)
            held.append((simple, self.ASCII.findall(data.lower()) if simple else data.split()))
        words = {w for simple, parts in held if not simple for w in parts}
        self.words = self._room(self.words, words)
        fresh = {w: self._pieces(w) for w in words if w not in self.words}
        needed = {p for simple, parts in held if simple for p in parts}
        needed.update(p for found in fresh.values() for p in found if isinstance(p, bytes))
        self.pieces = self._room(self.pieces, needed)
        new = [p for p in needed if p not in self.pieces]
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self.pieces.update(zip(some, self.merges.encode(some)))
        for w, found in fresh.items():
            self.words[w] = b"".join([p.to_bytes(4, "little") if isinstance(p, int) else self.pieces[p] for p in found])
        return [b"".join(map((self.pieces if simple else self.words).__getitem__, parts)) for simple, parts in held]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(r, "<u4").tolist() for r in self.raw(texts)]

    def decode(self, ids: list[int]) -> str:
        """The tokens of ids, special ones too, joined by spaces: the tokenizer has no decoder of its own.  Ids that it does
        not have show nothing."""
        try:
            return " ".join(map(self.shown.__getitem__, ids))
        except IndexError:
            return " ".join(self.shown[i] for i in ids if i < len(self.shown))


_codecs: dict[int, Codec] = {}


def codec_of(tokenizer_json: str) -> Codec:
    """One codec for each tokenizer in a worker: the words that it has met serve the worker's next tasks."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _codecs:
        _codecs[key] = Codec(tokenizer_json)
    return _codecs[key]


def _shipped(docs: DataFrame, tokenizer_path: str):
    with open(tokenizer_path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: of fixed size


def encode_texts(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the array column ``ids``: whole texts encoded, without special tokens added.

    Null and empty texts have no ids.  Rows are encoded one by one: ties and repeated rows are no special case.  A column named
    like ``ids`` is replaced.
    """
    shipped = _shipped(docs, tokenizer_path)

    def make():
        codec = codec_of(shipped.value)
        return lambda batch: {ids: codec.encode(texts_of(batch, text))}

    return with_columns(docs, f"`{ids}` array<int>", make, rows=256)


def decode_ids(docs: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the column ``decoded``: the tokens of ``ids`` joined by spaces; null ids give an empty text."""
    shipped = _shipped(docs, tokenizer_path)

    def make():
        codec = codec_of(shipped.value)
        return lambda batch: {text: [codec.decode([i for i in x or [] if i is not None]) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]}

    return with_columns(docs, f"`{text}` string", make, rows=256)


def round_trip(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256`` (of decimal ids joined by one space) and ``decoded_sha256`` (of the decoded ids).

    One row for each row of ``docs``, repeated and null ids among them; null and empty texts have no ids and decode to nothing.
    Other columns are ignored.
    """
    shipped = _shipped(docs, tokenizer_path)

    def make():
        codec = codec_of(shipped.value)
        digits = codec.digits.__getitem__

        def work(batch: pa.RecordBatch) -> dict:
            out: dict = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for raw in codec.raw(texts_of(batch, "_t")):
                ids = np.frombuffer(raw, "<u4").tolist()
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(sha256(" ".join(map(digits, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(sha256(codec.decode(ids).encode()).hexdigest())
            return out

        return work

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("_t"))
    return with_columns(rows, "n_tokens long, ids_sha256 string, decoded_sha256 string", make, rows=256).drop("_t")

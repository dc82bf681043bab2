"""Dense vectors learned from a catalog: a randomised factorisation of its n-gram matrix.

A row of the matrix is an item: counts of hashed character n-grams, weighted by rarity, of length 1.  The right singular vectors
of its largest singular values are found by subspace iteration from random directions.  A round is one pass over the items:
every task multiplies its rows twice and gives one partial sum, which are added block by block in a shuffle; the driver
only makes the columns orthogonal again.  All that it holds is ``buckets * dim`` numbers, whatever the number of items.

Texts that share no n-gram, but whose n-grams come with the same others, get similar vectors, which hashed counts cannot give.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stages import spread, staged


@dataclass(frozen=True)
class Settings:
    dim: int = 128
    buckets: int = 1 << 15  # hashed n-grams
    rounds: int = 3
    block: int = 512  # rows of the factor that are added together
    seed: int = 17


class Rows:
    """Texts as rows of the matrix; the places of a word's n-grams are kept from one text to the next."""

    def __init__(self, s: Settings, rarity: np.ndarray | None = None):
        self.s, self.rarity = s, rarity
        self.words: dict[str, list[int]] = {}

    def places(self, text: str) -> list[int]:
        if len(self.words) > 100_000:
            self.words.clear()
        out: list[int] = []
        for word in text.lower().split():
            got = self.words.get(word)
            if got is None:
                w = f" {word} "
                got = self.words[word] = [zlib.crc32(w[i : i + n].encode()) % self.s.buckets for n in (2, 3, 4) for i in range(len(w) - n + 1)]
            out += got
        return out

    def dense(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams that some text has, and one row for each text over just these."""
        each = [self.places(t) for t in texts]
        known, at = np.unique(np.array([p for e in each for p in e], np.int64), return_inverse=True)
        row = np.repeat(np.arange(len(texts)), [len(e) for e in each])
        x = np.bincount(row * len(known) + at, minlength=len(texts) * len(known)).reshape(len(texts), len(known)).astype(float)
        if self.rarity is not None and len(known):
            x *= self.rarity[known]
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return known, x


def _texts(parts: Iterator[pd.DataFrame], size: int = 256) -> Iterator[tuple[list[str], np.ndarray]]:
    """Texts, and how often each comes."""
    for pdf in parts:
        texts, n = [t or "" for t in pdf["t"]], pdf["n"].to_numpy()
        for i in range(0, len(texts), size):
            yield texts[i : i + size], n[i : i + size, None]


def _added(texts: DataFrame, width: int, s: Settings, work: Callable[[Iterator[tuple[list[str], np.ndarray]], np.ndarray], None]) -> np.ndarray:
    """The sum of what tasks write into a matrix of ``buckets`` rows; blocks that a task left empty do not travel."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((s.buckets, width))
        work(_texts(parts), total)
        for i in range(0, s.buckets, s.block):
            part = total[i : i + s.block]
            if part.any():
                yield pd.DataFrame({"block": [i], "data": [part.tobytes()]})

    def add(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(s.block * width)
        for pdf in parts:
            for d in pdf["data"]:
                held = np.frombuffer(d)
                total[: len(held)] += held
        yield pd.DataFrame({"block": [key[0]], "data": [total.tobytes()]})

    sums = texts.mapInPandas(run, "block int, data binary").groupBy("block").applyInPandas(add, "block int, data binary")
    out = np.zeros((s.buckets, width))
    for r in sums.collect():  # buckets * width numbers
        part = np.frombuffer(r["data"]).reshape(-1, width)
        out[r["block"] : r["block"] + s.block] = part[: len(out[r["block"] :])]
    return out


@dataclass(frozen=True)
class Learned:
    """A factor and the rarities it was learned with, shipped once to each executor."""

    s: Settings
    shipped: Broadcast

    def __call__(self) -> Callable[[list[str]], np.ndarray]:
        """The encoder in a worker, as ``similarity.encode`` takes it: rows of length 1, zeros for a text without n-grams."""
        rarity, factor = self.shipped.value
        rows = Rows(self.s, rarity)

        def encode(texts: list[str]) -> np.ndarray:
            known, x = rows.dense(texts)
            y = x @ factor[known]
            return (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)).astype(np.float32)

        return encode


def learn(items: DataFrame, text: Column | str = "clean_description", s: Settings = Settings()) -> Learned:
    """An encoder from all texts of ``items``; null and empty ones add nothing, repeated ones count as often as they come."""
    each = items.groupBy((F.col(text) if isinstance(text, str) else text).alias("t")).agg(F.count("*").alias("n"))
    texts = staged(spread(each, "t"))  # a text is counted and multiplied once, whatever the number of its items

    def count(parts: Iterator[tuple[list[str], np.ndarray]], total: np.ndarray) -> None:
        rows = Rows(s)
        for some, n in parts:
            known, x = rows.dense(some)
            total[known, 0] += ((x > 0) * n).sum(axis=0)

    df = _added(texts, 1, s, count)[:, 0]
    rarity = np.log((1 + (texts.agg(F.sum("n")).first()[0] or 0)) / (1 + df)) + 1
    rng = np.random.default_rng(s.seed)
    factor = np.linalg.qr(rng.normal(size=(s.buckets, s.dim)))[0]
    for _ in range(s.rounds):
        shipped = items.sparkSession.sparkContext.broadcast((rarity, factor))

        def multiply(parts: Iterator[tuple[list[str], np.ndarray]], total: np.ndarray, shipped=shipped) -> None:
            rarity, factor = shipped.value
            rows = Rows(s, rarity)
            for some, n in parts:
                known, x = rows.dense(some)
                total[known] += x.T @ (n * (x @ factor[known]))

        product = _added(texts, s.dim, s, multiply)
        # directions that no text has stay as they are; the others turn towards the largest singular values
        factor = np.linalg.qr(product + 1e-9 * factor)[0]
        shipped.unpersist()
    return Learned(s, items.sparkSession.sparkContext.broadcast((rarity, factor.astype(np.float32))))

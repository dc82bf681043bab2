"""Phrases whose words come together more often than their parts do apart.

Identical pieces are one row with a multiplicity.  Their n-grams are counted with these weights, shorter ones first: a phrase
that occurs often enough holds only phrases that do, so n-grams with a rare part are never dealt out.  Which parts are rare is
told by a bitmap of hashed frequent phrases; its size is fixed, and a collision only lets a rare one pass, whose count then
tells.  What is left is summed within its task, dealt by hash, and counted in duckdb, out of core, one bucket a task.

Parts of a candidate are at least as frequent as the candidate, so their counts are among those found.  They are asked for by
requests that meet the counts in a shuffle; parts that very many candidates ask for are few and are broadcast.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_known, single_threaded, written

SUMS = "lang string, phrase string, n int, m long"
KIND = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int32()), ("m", pa.int64())])


class Settings(NamedTuple):
    longest: int = 4  # words of a candidate
    least: int = 30  # occurrences of a candidate
    best: int = 2000  # candidates reported for each language
    covered: int = 80  # per cent of a candidate's occurrences within one longer candidate that drop it
    scale: int = 2_000_000
    unknown: str = "und"
    filter_bits: int = 26  # the bitmap has 2 ** filter_bits places, 8 MB
    chunk: int = 1 << 20  # words that a task sums before it gives rows
    memory: str = "256MB"  # of one counting task, beyond which it spills


def pieces_of(docs: DataFrame, s: Settings, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, piece, m, words``: distinct pieces, words joined by one space, with multiplicity and number of words."""
    upper, lower = (bytes(range(c, c + 26)).decode() for c in (65, 97))
    low = F.translate(F.coalesce(F.col(text), F.lit("")), upper, lower)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(s.unknown)).alias("lang"), F.explode(F.split(low, r"[.,;:!?\x0A-\x0D]+")).alias("p"))
    rows = rows.select("lang", F.trim(F.regexp_replace("p", r"[\x20\x09]+", " ")).alias("piece")).filter("piece <> ''")
    once = rows.groupBy("lang", "piece").agg(F.count("*").alias("m"))
    return once.withColumn("words", F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1)


def place_of(lang: str, words: list[str], bits: int) -> int:
    """The bit of a phrase: its words' hashes, mixed in order."""
    h = np.array([word_hash(lang, w) for w in words], np.uint64)
    return int(mixed([h[i : i + 1] for i in range(len(h))], bits)[0])


def word_hash(lang: str, word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{lang}\0{word}")


def mixed(hashes: list[np.ndarray], bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = reduce(lambda a, b: (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b, hashes)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(frequent: DataFrame, bits: int) -> Broadcast:
    """The places of all phrases of ``frequent`` in a bitmap of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.array([place_of(g, p.split(" "), bits) for g, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], ["i", "b"])

    words = frequent.select("lang", "phrase").mapInArrow(run, "i long, b long").groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << bits - 5, np.uint32)  # at most as many rows as it has places came to the driver
    table[words.column("i").to_numpy()] = words.column("b").to_numpy().astype(np.uint32)
    return frequent.sparkSession.sparkContext.broadcast(table)


class Chunk:
    """Words of some pieces in one flat array."""

    def __init__(self, lang: pa.Array, piece: pa.Array, m: np.ndarray):
        cut = pc.split_pattern(piece, " ")
        sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
        langs, words = pc.dictionary_encode(lang), pc.dictionary_encode(cut.flatten())
        self.piece = np.repeat(np.arange(len(sizes)), sizes)
        self.m = m[self.piece]
        owner = langs.indices.to_numpy()[self.piece].astype(np.int64)
        known = len(words.dictionary)
        # a word of two languages is two words
        both, self.code = np.unique(owner * known + words.indices.to_numpy(), return_inverse=True)
        self.lang = langs.dictionary.take(pa.array(both // known)).cast(pa.string())
        self.word = words.dictionary.take(pa.array(both % known)).cast(pa.string())

    def hashes(self) -> np.ndarray:
        each = map(word_hash, self.lang.to_pylist(), self.word.to_pylist())
        return np.fromiter(each, np.uint64, len(self.word))

    def sums(self, n: int, at: np.ndarray) -> pa.RecordBatch:
        """The distinct n-grams that begin ``at`` these places, with the sum of their multiplicities."""
        key, size = self.code, len(self.word)
        parts = key[at]
        for i in range(1, n):  # numbers of shorter n-grams stay below the number of words, so keys stay below 2 ** 63
            _, parts = np.unique(parts * size + key[at + i], return_inverse=True)
        order = np.argsort(parts, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(parts[order]) != 0]) if len(at) else np.zeros(0, np.int64)
        total = np.add.reduceat(self.m[at][order], starts) if len(at) else np.zeros(0, np.int64)
        first = at[order[starts]]
        held = [self.word.take(pa.array(key[first + i])) for i in range(n)]
        phrase = pc.binary_join_element_wise(*held, " ") if n > 1 else held[0]
        return pa.RecordBatch.from_arrays([self.lang.take(pa.array(key[first])), phrase, pa.array(np.full(len(first), n, np.int32)), pa.array(total.astype(np.int64))], schema=KIND)


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Chunk]:
    """Pieces of about ``size`` words together; one very long piece is one chunk."""
    held, n = [], 0

    def chunk() -> Chunk:
        t = pa.Table.from_batches(held).combine_chunks()
        lang, piece, m = (t.column(i).chunk(0) for i in range(3))
        return Chunk(lang, piece, m.to_numpy())

    for big in batches:
        at = 0
        while at < big.num_rows:
            ends = np.cumsum(big.column(3).slice(at).to_numpy())
            take = max(1, int(np.searchsorted(ends, size - n, side="right")))
            if held and n + int(ends[take - 1]) > size:
                yield chunk()
                held, n = [], 0
                continue
            held.append(big.slice(at, take))
            n += int(ends[take - 1])
            at += take
    if held:
        yield chunk()


def grams(pieces: DataFrame, lengths: list[int], known: Broadcast | None, order: int, s: Settings) -> DataFrame:
    """``lang, phrase, n, m``: partial sums of n-grams whose contiguous parts of ``order`` words are all in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, s.chunk):
            total = len(c.code)
            fine = np.ones(total, bool)
            if known is not None:
                h = c.hashes()[c.code]
                shown = mixed([h[i : total - order + 1 + i] for i in range(order)], s.filter_bits) if total >= order else np.zeros(0, np.int64)
                fine[:] = False
                fine[: len(shown)] = known.value[shown >> 5] >> (shown & 31).astype(np.uint32) & 1
            for n in lengths:
                at = np.flatnonzero(c.piece[: total - n + 1] == c.piece[n - 1 :]) if total >= n else np.zeros(0, np.int64)
                for i in range(n - order + 1 if known is not None else 0):
                    at = at[fine[at + i]]
                yield c.sums(n, at)

    return pieces.mapInArrow(run, SUMS)


def counted(sums: DataFrame, s: Settings) -> DataFrame:
    """Phrases that occur ``least`` times or more, with their counts: each bucket is counted by one task in duckdb.

    duckdb spills to a scratch folder of the task's own, which goes when the task ends; a task that is run again begins anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        import duckdb

        scratch = tempfile.mkdtemp(prefix="count-")
        con = duckdb.connect(os.path.join(scratch, "grams.db"), config={"threads": 1, "memory_limit": s.memory, "temp_directory": scratch, "preserve_insertion_order": False})
        try:
            con.execute("CREATE TABLE grams (lang VARCHAR, phrase VARCHAR, n INTEGER, m BIGINT)")
            held, rows = [], 0

            def store() -> None:
                con.from_arrow(pa.Table.from_batches(held)).insert_into("grams")

            for b in batches:
                held.append(b)
                rows += b.num_rows
                if rows >= 200_000:
                    store()
                    held, rows = [], 0
            if held:
                store()
            found = con.sql(f"SELECT lang, phrase, n, CAST(sum(m) AS BIGINT) AS m FROM grams GROUP BY ALL HAVING sum(m) >= {s.least}")
            for b in found.to_arrow_reader(50_000):
                yield b.cast(KIND)
        finally:
            con.close()
            shutil.rmtree(scratch, True)

    return sums.repartition(F.xxhash64("lang", "phrase")).mapInArrow(run, SUMS)


def frequent_phrases(pieces: DataFrame, s: Settings) -> DataFrame:
    """``lang, phrase, n, f``: all phrases up to ``longest`` words that occur ``least`` times or more."""
    words = written(counted(grams(pieces, [1], None, 1, s), s), "words")
    pairs = written(counted(grams(pieces, [2], bitmap(words, s.filter_bits), 1, s), s), "pairs")
    longer = [n for n in range(3, s.longest + 1)]
    levels = [words, pairs]
    if longer:
        levels.append(written(counted(grams(pieces, longer, bitmap(pairs, s.filter_bits), 2, s), s), "phrases"))
    return reduce(DataFrame.unionByName, levels).withColumnRenamed("m", "f")


def scored(frequent: DataFrame, s: Settings) -> DataFrame:
    """Candidates with the counts of both parts of their lowest-scoring cut (ties: the earliest), ``lang, phrase, a, l, r, score``."""
    candidates = frequent.filter("n >= 2").select("lang", "phrase", F.col("f").alias("a"), "n")
    cuts = candidates.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.expr("array_join(slice(w, 1, k), ' ')").alias("part")), F.struct(F.lit(1).alias("side"), F.expr("array_join(slice(w, k + 1, n - k), ' ')").alias("part")))
    requests = cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("x")).select("lang", "phrase", "a", "k", "x.side", "x.part")
    asked = requests.groupBy("lang", "part").agg(F.count("*").alias("asked"))
    counts = frequent.select("lang", F.col("phrase").alias("part"), "f")
    answers = join_known(requests, written(asked.join(counts, ["lang", "part"]), "parts"), ["lang", "part"], "asked")
    both = answers.groupBy("lang", "phrase", "a", "k").agg(F.sum(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.sum(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr(f"cast(a as decimal(20,0)) * {s.scale} div (cast(l as decimal(20,0)) + r)").alias("score")
    least = both.select("lang", "phrase", "a", F.struct(score, "k", "l", "r").alias("c")).groupBy("lang", "phrase", "a").agg(F.min("c").alias("c"))
    return least.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def uncovered(found: DataFrame, frequent: DataFrame, s: Settings) -> DataFrame:
    """``found`` without those of which a longer candidate covers too much."""
    longer = frequent.filter("n >= 3").select("lang", "f", F.split("phrase", " ").alias("w"), "n")
    inner = longer.withColumn("k", F.explode(F.expr("sequence(2, n - 1)"))).withColumn("i", F.explode(F.expr("sequence(1, n - k + 1)")))
    most = inner.groupBy("lang", F.expr("array_join(slice(w, i, k), ' ')").alias("phrase")).agg(F.max("f").alias("most"))
    kept = F.expr(f"most is null or 100bd * most < cast({s.covered} as decimal(20,0)) * a")
    return found.join(most, ["lang", "phrase"], "left").filter(kept).drop("most")


def collocations(docs: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``best`` phrases.

    Null texts are empty, a null language is ``und``; empty texts and pieces without a word give nothing, an empty table no rows.
    Repeated rows count as often as they come.  Ties of score are ordered by count and then by the phrase's bytes.  Columns
    other than these two are ignored.
    """
    s = settings
    pieces = written(pieces_of(docs, s, text, lang), "pieces")
    frequent = frequent_phrases(pieces, s)
    totals = pieces.groupBy("lang").agg(F.sum(F.col("m") * F.col("words")).alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = uncovered(scored(frequent, s), frequent, s).withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= s.best)
    # languages are as few as their column has values: their totals meet the ranked rows in a join of any size
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("n").cast("long").alias("n"), "score")

"""b-bit MinHash near-duplicate detection.

A text is the set of its distinct word shingles (64-bit hashes).  Equal sets form one class first, so that copies are never
paired.  Minima of ``bands * rows`` hash functions give band keys; their low bits are packed into a signature.  Classes that
share a band key are candidates; bit counts on the signatures estimate their similarity, corrected for chance agreement of b
bits, and drop clear misses; the full sets decide the rest.

Candidates are not all pairs of a bucket: each class is first compared with its bucket's smallest, its head, and connected
components are formed.  What is left are the classes of a head in different components.  They are dealt into blocks of bounded
size; each pair of blocks is compared in one task by matrices of bit counts and of shingle counts, and only links come out.
So a group of near copies costs as many rows as it has members, and no link between components is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import many_objects, single_threaded, texts_of, with_columns, written
from .graph import components


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 80  # link: 100 * intersection >= percent * union
    bands: int = 32
    rows: int = 4  # at a similarity of 0.8 a pair shares no band with probability 5e-8
    bits: int = 4
    block: int = 512  # classes of a block
    slack: float = 5.0  # standard deviations of the estimate that a candidate may lie below the threshold
    seed: int = 11

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, size: int, keep: int = 400_000):
        self.size, self.keep, self.known = size, keep, {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
        if len(self.known) > self.keep:
            self.known.clear()
        for w in set().union(*split).difference(self.known):
            self.known[w] = xxh3_64_intdigest(w)
        get, out = self.known.__getitem__, []
        with np.errstate(over="ignore"):
            for words in split:
                h = np.fromiter(map(get, words), np.uint64, len(words))
                n = min(self.size, len(h))  # fewer words than a shingle: the whole sequence is one
                key = np.full(max(0, len(h) - n + 1) if n else 0, 0x9E3779B97F4A7C15 + n, np.uint64)
                for j in range(n):
                    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + h[j : j + len(key)]
                key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                out.append(np.unique(key ^ (key >> np.uint64(32))))
        return out


def signatures(sets: list[np.ndarray], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (sets x bands) and packed low bits (sets x words) of sets that are not empty."""
    rng = np.random.default_rng(s.seed)
    a = rng.integers(0, 1 << 32, s.hashes, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, s.hashes, dtype=np.uint32)
    x = (np.concatenate(sets) >> np.uint64(16)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(v) for v in sets])[:-1]]).astype(np.int64)
    low = np.empty((len(sets), s.hashes), np.uint32)
    y = np.empty_like(x)
    for i in range(s.hashes):
        np.multiply(x, a[i], out=y)
        np.add(y, b[i], out=y)
        np.bitwise_xor(y, y >> np.uint32(15), out=y)
        low[:, i] = np.minimum.reduceat(y, starts)
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(1, s.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sets), 1))
        for j in range(s.rows):
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + low[:, j :: s.rows]
        key = (key ^ (key >> np.uint64(33))) * np.uint64(0xBF58476D1CE4E5B9)
        each = 64 // s.bits
        bits = (low & np.uint32((1 << s.bits) - 1)).astype(np.uint64).reshape(len(sets), -1, each)
        packed = (bits << (np.arange(each, dtype=np.uint64) * np.uint64(s.bits))).sum(2, dtype=np.uint64)
    return key.view(np.int64), packed.view(np.int64)


def _lists(rows: np.ndarray, have: np.ndarray) -> pa.Array:
    """Arrays of longs, empty where ``have`` is false."""
    offsets = np.concatenate([[0], np.cumsum(np.where(have, rows.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), pa.int64()))


def sign(docs: DataFrame, s: Settings, text: str) -> DataFrame:
    """``docs`` with ``_n`` (set size), ``_key`` (of the whole set; null if empty), ``_bands`` and ``_sig``."""

    def make():
        single_threaded()
        many_objects()
        shingle = Shingler(s.shingle)

        def work(batch: pa.RecordBatch) -> dict:
            sets = shingle(texts_of(batch, text))
            sizes = np.array([len(v) for v in sets], np.int64)
            have = sizes > 0
            full = [v for v in sets if len(v)]
            bands, sig = signatures(full, s) if full else (np.zeros((0, s.bands), np.int64), np.zeros((0, 1), np.int64))
            return {"_n": sizes, "_key": [xxh3_128_digest(v.tobytes()) if len(v) else None for v in sets], "_bands": _lists(bands, have), "_sig": _lists(sig, have)}

        return work

    return with_columns(docs, "_n long, _key binary, _bands array<long>, _sig array<long>", make, rows=128)


def estimate(a: str, b: str, s: Settings):
    """Similarity by bit counts: the share of equal b-bit values, without what agrees by chance."""
    ones = sum(1 << (i * s.bits) for i in range(64 // s.bits))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones
    x = "bigint(x ^ y)"
    folded = " | ".join(f"shiftrightunsigned({x}, {i})" for i in range(s.bits))
    differ = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(({folded}) & {ones}L)), 0, (t, v) -> t + v)")
    chance = 1.0 / (1 << s.bits)
    return (1 - differ / F.lit(float(s.hashes)) - chance) / (1 - chance)


def least_estimate(s: Settings) -> float:
    j, c = s.percent / 100, 1.0 / (1 << s.bits)
    p = c + (1 - c) * j
    return j - s.slack * (p * (1 - p) / s.hashes) ** 0.5 / (1 - c)


def texts_by_id(docs: DataFrame, ids: DataFrame, doc_id: str, text: str, buckets: int = 1 << 20) -> DataFrame:
    """``id, t`` of the rows whose id is in ``ids``.

    Most texts are no candidates: before the join on ids, hash buckets of ids, of a fixed number at any size, are broadcast and
    let only rows of wanted buckets into the shuffle.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
    wanted = ids.select(bucket("id").alias("k")).distinct()
    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("t"))
    return rows.join(F.broadcast(wanted), bucket("id") == F.col("k"), "left_semi").join(ids, "id")


def verified(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (``a, b``) whose full sets, of ``texts`` (``id, t``), are similar enough."""
    both = pairs.select("a", "b").join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")

    def make():
        single_threaded()
        shingle = Shingler(s.shingle)

        def work(batch: pa.RecordBatch) -> dict:
            left, right = texts_of(batch, "ta"), texts_of(batch, "tb")
            once = {t: None for t in left + right}
            sets = dict(zip(once, shingle(list(once))))
            ok = []
            for x, y in zip(left, right):
                p, q = sets[x], sets[y]
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(common > 0 and 100 * common >= s.percent * (len(p) + len(q) - common))
            return {"_ok": np.array(ok, bool)}

        return work

    return with_columns(both.select("a", "b", "ta", "tb"), "_ok boolean", make, rows=64).filter("_ok").select("a", "b").distinct()


def links_between(sets: list[np.ndarray], component: np.ndarray, own: np.ndarray, side: np.ndarray | None, s: Settings) -> np.ndarray:
    """Pairs of rows (n x 2) in different components that are similar enough; with ``side``, only across its two values.

    ``own`` is true for rows of the head's component, which are not compared with each other.
    """
    n = np.array([len(v) for v in sets], np.int64)
    sig = signatures(sets, s)[1].view(np.uint64)
    i, j = np.nonzero(np.triu(component[:, None] != component[None, :], 1))
    ok = ~(own[i] & own[j]) & (100 * n[i] >= s.percent * n[j]) & (100 * n[j] >= s.percent * n[i])
    if side is not None:
        ok &= side[i] != side[j]
    i, j = i[ok], j[ok]
    ones = np.uint64(sum(1 << (k * s.bits) for k in range(64 // s.bits)))
    chance, keep = 1.0 / (1 << s.bits), []
    for lo in range(0, len(i), 100_000):
        x = sig[i[lo : lo + 100_000]] ^ sig[j[lo : lo + 100_000]]
        y = x.copy()
        for k in range(1, s.bits):
            y |= x >> np.uint64(k)
        equal = 1 - np.bitwise_count(y & ones).sum(1) / s.hashes
        keep.append((equal - chance) / (1 - chance) >= least_estimate(s))
    if not len(i):
        return np.zeros((0, 2), np.int64)
    keep = np.concatenate(keep)
    i, j = i[keep], j[keep]
    if len(i) <= 4 * len(sets):
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    else:  # only shingles of two rows or more can be common
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), n)
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        col = np.cumsum(new) - 1
        shared = np.bincount(col)[col] > 1
        row, col = row[shared], col[shared]
        col = np.unique(col, return_inverse=True)[1]
        total = np.zeros((len(sets), len(sets)), np.float32)
        width = 4096
        for lo in range(0, int(col.max()) + 1 if len(col) else 0, width):
            at = (col >= lo) & (col < lo + width)
            m = np.zeros((len(sets), width), np.float32)
            m[row[at], col[at] - lo] = 1
            total += m @ m.T
        common = total[i, j].astype(np.int64)
    hit = (common > 0) & (100 * common >= s.percent * (n[i] + n[j] - common))
    return np.stack([i[hit], j[hit]], 1)


def _compare_blocks(s: Settings):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        single_threaded()
        shingle, key, held, out = Shingler(s.shingle), None, [], []

        def close():
            if len(held) > 1:
                cls, component, block, own, texts = zip(*held)
                side = None if key[1] == key[2] else np.array(block)
                for i, j in links_between(shingle(list(texts)), np.array(component), np.array(own), side, s):
                    out.append((min(cls[i], cls[j]), max(cls[i], cls[j])))

        for b in batches:
            for *k, cls, component, block, own, text in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    close()
                    key, held = k, []
                held.append((cls, component, block, own, text or ""))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return run


def links_across(placed: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Links between classes of one head (``head, cls, component``) that are in different components.

    Rows of the head's own component meet the others' blocks only; they are not compared with each other.
    """
    home = placed.filter("cls = head").select("head", F.col("component").alias("home")).distinct()
    rows = placed.join(home, "head").withColumn("own", F.col("component") == F.col("home"))
    sizes = rows.groupBy("head").agg(F.count_if("own").alias("n0"), F.count_if(~F.col("own")).alias("n1")).filter("n1 > 0")
    sizes = sizes.select("head", F.expr(f"cast(ceil(n0 / {s.block}.0) as int)").alias("b0"), F.expr(f"cast(ceil(n1 / {s.block}.0) as int)").alias("b1"))
    dealt = rows.join(sizes, "head").withColumn("block", F.expr("cast(if(own, pmod(xxhash64(cls), b0), b0 + pmod(xxhash64(cls), b1)) as int)"))
    # own rows: one copy for each block of others; others: one for each block of any kind
    dealt = dealt.withColumn("other", F.explode(F.expr("if(own, sequence(b0, b0 + b1 - 1), sequence(0, b0 + b1 - 1))")))
    dealt = dealt.select("head", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "cls", "component", "block", "own")
    full = dealt.join(texts.withColumnRenamed("id", "cls"), "cls").select("head", "lo", "hi", "cls", "component", "block", "own", "t")
    return full.repartition("head", "lo", "hi").sortWithinPartitions("head", "lo", "hi").mapInArrow(_compare_blocks(s), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id reachable by links, ``kept`` is true for the row that bears it.  Null, empty and
    blank texts have no shingles and link with nothing.  A text of fewer words than a shingle has one: the whole sequence.
    Rows that share an id count as one document with all their links; rows without an id get the component of their equals, or
    none, and are not kept.  Other columns are ignored.
    """
    own = docs.select(docs[doc_id].alias("_id"), docs[text].alias("_text"))
    signed = written(sign(own, s, "_text").drop("_text"), "signatures")
    classes = written(
        signed.filter("_key is not null and _id is not null").groupBy("_key").agg(F.min("_id").alias("cls"), F.first("_bands").alias("bands"), F.first("_sig").alias("sig")),
        "classes",
    )
    rows = classes.select("cls", F.explode("bands").alias("band"))
    heads = rows.groupBy("band").agg(F.min("cls").alias("head"), F.count("*").alias("k")).filter("k > 1").drop("k")
    crowded = written(rows.join(heads, "band"), "crowded")
    sigs = classes.select("cls", "sig")
    texts = written(texts_by_id(own, crowded.select(F.col("cls").alias("id")).distinct(), "_id", "_text"), "candidate-texts")

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs whose estimate is not clearly too low."""
        x = pairs.join(sigs.select(F.col("cls").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("cls").alias("b"), F.col("sig").alias("sb")), "b")
        return x.filter(estimate("sa", "sb", s) >= least_estimate(s)).select("a", "b").distinct()

    stars = written(likely(crowded.filter("cls <> head").select(F.col("head").alias("a"), F.col("cls").alias("b")).distinct()), "star-pairs")
    edges = written(verified(stars, texts, s), "star-links")
    labels = components(edges) if not edges.isEmpty() else None
    placed = crowded.withColumn("component", F.col("cls")) if labels is None else crowded.join(labels.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    placed = placed.select("head", "cls", "component").distinct()
    more = written(links_across(placed, texts, s), "other-links")
    if not more.isEmpty():
        labels = components(edges.union(more))
    out = signed.select("_id", "_n", "_key").join(classes.select("_key", "cls"), "_key", "left")
    if labels is not None:
        out = out.join(labels.withColumnRenamed("id", "cls"), "cls", "left")
        component = F.coalesce("component", "cls", "_id")
    else:
        component = F.coalesce("cls", "_id")
    return out.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))

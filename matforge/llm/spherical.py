"""Near-duplicate vectors by spherical-cap filters.

Filter directions are a structured random product code: after a random rotation the space is cut into blocks, each block has
its own random codewords, and every choice of one codeword per block is a filter.  List decoding finds all filters whose
direction a unit vector exceeds by a threshold, without visiting the rest; a vector that exceeds few gets its best ones.
Vectors with equal labels that share a filter are compared in double precision.

A pair at the threshold shares no filter of one code with a probability that depends on its angle only (rotations are uniform)
and grows with the number of codewords.  So it is measured for the code at hand, and independent codes are added until all
of them miss such a pair with probability ``miss`` at most.

Equal vectors form one class first.  Near copies of one vector crowd the same filters; those within half the threshold's angle
of the mean of such a crowd form a ball.  Any two of a ball are linked by the triangle inequality, so they are counted, not
compared.  A crowded filter is cut into blocks of bounded size and pairs of blocks are compared as matrices in a task of their
own; blocks of one ball do not meet each other; pairs are never rows.  A pair that shares several filters is counted in its
smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import acos, cos
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_known, single_threaded, with_columns, written
from .graph import components

PARTS = 4


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.98
    filters: int = 8  # expected by vector, of each code
    least: int = 6  # a vector that exceeds fewer gets so many of its best
    miss: float = 1e-8  # bound for a pair at the threshold
    probes: int = 2000  # pairs that measure one code
    block: int = 1024
    crowd: int = 32  # vectors in one filter among which a ball is looked for
    seed: int = 17


class Code:
    """Product code for vectors of ``dim`` components; ``words`` codewords for each of four blocks."""

    def __init__(self, dim: int, words: int, s: Settings, number: int = 0):
        rng = np.random.default_rng([s.seed, dim, words, number])
        self.size = -(-max(dim, 2 * PARTS) // PARTS)
        self.words, self.s, self.dim = words, s, dim
        q, r = np.linalg.qr(rng.normal(size=(self.size * PARTS,) * 2))
        self.turn = (q * np.sign(np.diag(r)))[:, :dim]
        c = rng.normal(size=(PARTS, words, self.size))
        self.c = c / np.linalg.norm(c, axis=2, keepdims=True) / PARTS**0.5
        share = min(0.5, s.filters / words**PARTS)
        self.level = NormalDist().inv_cdf(1 - share) / (self.size * PARTS) ** 0.5

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted filter numbers of each unit vector."""
        x = (unit @ self.turn.T).reshape(len(unit), PARTS, self.size)
        y = np.einsum("npd,pwd->npw", x, self.c)
        w = self.words
        first = (y[:, 0, :, None] + y[:, 1, None, :]).reshape(len(unit), -1)
        second = (y[:, 2, :, None] + y[:, 3, None, :]).reshape(len(unit), -1)
        out = []
        for a, b in zip(first, second):
            level, want = self.level, min(self.s.least, w**PARTS)
            while True:
                i, j = np.flatnonzero(a >= level - b.max()), np.flatnonzero(b >= level - a.max())
                sums = a[i][:, None] + b[j][None, :]
                k, m = np.nonzero(sums >= level)
                if len(k) >= want:
                    break
                level -= 0.3 / (self.size * PARTS) ** 0.5
            ids = i[k] * (w * w) + j[m]
            if level < self.level and len(ids) > want:  # the best ones only
                ids = ids[np.argsort(-sums[k, m], kind="stable")[:want]]
            out.append(np.sort(ids))
        return out


def words_for(n: int, s: Settings) -> int:
    """Codewords of a block for ``n`` vectors: about three vectors in each filter."""
    return max(16, int(np.ceil((s.filters * n / 3) ** (1 / PARTS))))


class Codes:
    """So many independent codes that a pair at the threshold shares no filter with probability ``miss`` at most."""

    def __init__(self, dim: int, words: int, s: Settings):
        self.codes = [Code(dim, words, s)]
        self.missed = self._missed(s) if dim > 1 else 0.0  # of one code, an upper bound
        more = int(np.ceil(np.log(s.miss) / np.log(self.missed))) if self.missed else 1
        self.codes += [Code(dim, words, s, i) for i in range(1, more)]

    def _missed(self, s: Settings) -> float:
        """Share of random pairs at the threshold that share no filter of the first code, and two deviations more."""
        code = self.codes[0]
        u, v = np.random.default_rng([s.seed, code.dim]).normal(size=(2, s.probes, code.dim))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        v -= (u * v).sum(1, keepdims=True) * u
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        v = s.threshold * u + (1 - s.threshold**2) ** 0.5 * v
        k = sum(not np.intersect1d(a, b, assume_unique=True).size for a, b in zip(code.decode(u), code.decode(v)))
        return min(0.9, (k + 2 * k**0.5 + 3) / s.probes)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted filter numbers of each unit vector; those of a code follow those of the code before."""
        each = [code.decode(unit) for code in self.codes]
        return [np.concatenate([f + i * code.words**PARTS for i, (code, f) in enumerate(zip(self.codes, fs))]) for fs in zip(*each)]


def normed(x: np.ndarray) -> np.ndarray:
    """Unit vectors; components are scaled first, so that squares stay in range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@lru_cache(maxsize=8)
def codes_of(dim: int, words: int, s: Settings) -> Codes:
    """The codes of a dimension; a worker measures them once for all its tasks."""
    return Codes(dim, words, s)


def _codes(vectors: DataFrame, words: int, s: Settings) -> DataFrame:
    def make():
        single_threaded()
        def work(batch: pa.RecordBatch) -> dict:
            rows, out = batch.column(batch.schema.get_field_index("v")).to_pylist(), [None] * batch.num_rows
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(rows):
                by_dim.setdefault(len(v), []).append(i)
            for dim, at in by_dim.items():
                x = np.array([rows[i] for i in at], float)
                for i, f in zip(at, codes_of(dim, words, s).decode(normed(x))):
                    out[i] = f
            return {"fs": out}

        return work

    return with_columns(vectors, "fs array<long>", make, rows=256)


def _compare(s: Settings):
    """Sums over sorted groups ``(dim, label, f, lo, hi)``: for each vector its links and one neighbour or more that connect it."""
    schema = pa.schema([(c, pa.int64()) for c in ("cid", "cls", "links", "near")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        key, held, out = None, [], []  # held: the parts of a group that batches brought

        def close():
            if sum(len(h[0]) for h in held) < 2:
                return
            cid, cls, block, ball, mult, x, many, sets = held[0] if len(held) == 1 else map(np.concatenate, zip(*held))
            x = normed(x.astype(float))
            near = x @ x.T >= s.threshold
            np.fill_diagonal(near, False)
            if key[3] != key[4]:
                near &= block[:, None] != block[None, :]
            near &= (ball[:, None] != ball[None, :]) | (ball < 0)[:, None]  # those of one ball are counted with it
            if not near.any():
                return
            # of a pair that shares a smaller filter, the links are counted there
            live = np.flatnonzero(near.any(1))
            which = sets[np.repeat(near.any(1), many)]
            cid, cls, mult, many, near = cid[live], cls[live], mult[live], many[live], near[np.ix_(live, live)]
            names, times = np.unique(which, return_counts=True)
            names, counted = names[times > 1], near.copy()
            at = np.repeat(np.arange(len(live)), many)
            for lo in range(0, len(names), 4096):
                some = names[lo : lo + 4096]
                k = np.minimum(np.searchsorted(some, which), len(some) - 1)
                m = np.zeros((len(live), len(some)), np.float32)
                m[at[some[k] == which], k[some[k] == which]] = 1
                counted &= m @ m.T < 0.5
            links = counted @ mult
            label = cls.copy()
            while True:  # smallest class in reach, inside the group
                new = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(1))
                if (new == label).all():
                    break
                label = new
            out.extend(zip(cid.tolist(), cls.tolist(), links.tolist(), label.tolist()))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], [], []))], schema=schema)

        def lists(column) -> tuple[np.ndarray, np.ndarray]:
            """The values of all lists and where each begins (and the last ends)."""
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

        for b in batches:
            if not b.num_rows:
                continue
            col = {c: b.column(b.schema.get_field_index(c)) for c in ("dim", "label", "f", "lo", "hi", "cid", "cls", "block", "ball", "mult", "v", "earlier")}
            num = {c: col[c].to_numpy(zero_copy_only=False) for c in ("dim", "f", "lo", "hi", "cid", "cls", "block", "ball", "mult")}
            names = col["label"].to_pylist()
            (v, v_at), (e, e_at) = lists(col["v"]), lists(col["earlier"])
            new = np.array([x != y for x, y in zip(names[1:], names)], bool)
            for c in ("dim", "f", "lo", "hi"):
                new |= num[c][1:] != num[c][:-1]
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
            for i, j in zip(edges, edges[1:]):
                now = (int(num["dim"][i]), names[i], *(int(num[c][i]) for c in ("f", "lo", "hi")))
                if now != key:
                    close()
                    key, held = now, []
                held.append((*(num[c][i:j] for c in ("cid", "cls", "block", "ball", "mult")), v[v_at[i] : v_at[j]].reshape(j - i, -1), np.diff(e_at[i : j + 1]), e[e_at[i] : e_at[j]]))
            if len(out) > 20_000:
                yield batch()
                out.clear()
        close()
        yield batch()

    return run


def _balls(coded: DataFrame, crowds: DataFrame, s: Settings) -> DataFrame:
    """``cid, cls, mult, dim, label, ball``: classes within half the threshold's angle of the mean of their most crowded filter.

    ``ball`` is that filter.  The mean needs not be a vector of the table.  Sums are made before the shuffle, one row for each
    filter and component comes out of a task.
    """
    keys = ["dim", "label", "ball"]
    most = join_known(coded.select("dim", "label", "cid", F.explode("fs").alias("f")), crowds.filter(F.col("count") >= s.crowd).withColumn("k", F.col("count")), ["dim", "label", "f"])
    home = most.filter("count is not null").groupBy("cid").agg(F.max_by("f", F.struct("count", -F.col("f"))).alias("ball"))
    # lambdas over arrays of one: what they bind is computed once a vector, not once a component
    scaled = "transform(array(array_max(transform(v, x -> abs(double(x))))), t -> transform(v, x -> double(x) / t))[0]"
    norm = "sqrt(aggregate(u, 0D, (t, y) -> t + y * y))"
    unit = F.expr(f"transform(array({scaled}), u -> transform(array({norm}), n -> transform(u, x -> x / n))[0])[0]")
    at = written(coded.select("cid", "cls", "mult", "dim", "label", unit.alias("u")).join(home, "cid"), "vector-homes")
    sums = at.select(*keys, F.posexplode("u").alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"), F.count("*").alias("k"))
    means = sums.groupBy(*keys).agg(F.max("k").alias("k"), F.expr("transform(array_sort(collect_list(struct(i, x))), p -> p.x)").alias("mean"))
    dot = "aggregate(zip_with(u, mean, (x, y) -> x * y), 0D, (t, z) -> t + z)"
    size = "sqrt(aggregate(mean, 0D, (t, y) -> t + y * y))"  # nil where vectors cancel each other: no ball there
    limit = cos(acos(max(-1.0, min(1.0, s.threshold))) / 2) + 1e-9
    return join_known(at, written(means, "vector-means"), keys).filter(F.expr(f"{size} > 1e-6 and {dot} >= {limit!r} * {size}")).select("cid", "cls", "mult", *keys)


def _counted(balls: DataFrame) -> DataFrame:
    """``cid, cls, links, near`` for each class of a ball: all others of its ball, without comparing."""
    keys = ["dim", "label", "ball"]
    sizes = balls.groupBy(*keys).agg(F.sum("mult").alias("all"), F.min("cls").alias("near"), F.count("*").alias("k"))
    return join_known(balls, sizes, keys).select("cid", "cls", (F.col("all") - F.col("mult")).alias("links"), "near")


def _placed(coded: DataFrame, crowds: DataFrame, balls: DataFrame, s: Settings) -> DataFrame:
    """``cid, f, lo, hi, block, ball``: each class at the pairs of blocks of each filter where it may meet one that is not of its ball.

    The largest ball of a filter has blocks of its own, which meet the others' only.
    """
    keys = ["dim", "label", "f"]
    rows = coded.select("cid", "dim", "label", "fs").join(balls.select("cid", "ball"), "cid", "left")
    rows = rows.select("dim", "label", "cid", F.coalesce("ball", F.lit(-1)).alias("ball"), F.explode("fs").alias("f"))
    main = rows.filter("ball >= 0").groupBy(*keys, "ball").count().groupBy(*keys).agg(F.max(F.struct("count", "ball")).alias("m")).select(*keys, F.col("m.ball").alias("main"), F.col("m.count").alias("n0"))
    sizes = crowds.join(main, keys, "left").withColumn("n0", F.coalesce("n0", F.lit(0))).filter("count > n0")
    sizes = sizes.select(*keys, "main", F.expr(f"cast(ceil(n0 / {s.block}.0) as int)").alias("b0"), F.expr(f"cast(ceil((count - n0) / {s.block}.0) as int)").alias("b1"), F.col("count").alias("k"))
    dealt = join_known(rows, written(sizes, "vector-blocks"), keys).filter("b1 is not null").withColumn("own", F.coalesce(F.col("ball") == F.col("main"), F.lit(False)))
    dealt = dealt.withColumn("block", F.expr("if(own, pmod(xxhash64(cid, f), b0), b0 + pmod(xxhash64(cid, f), b1))"))
    dealt = dealt.withColumn("other", F.explode(F.expr("if(own, sequence(bigint(b0), b0 + b1 - 1), sequence(0L, b0 + b1 - 1))")))
    return dealt.select("cid", "f", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "ball")


def near_vectors(df: DataFrame, s: Settings = Settings(), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row for each row of ``df``: ``vec_id, n_links, component_id, kept``.

    A link joins two rows with equal labels that are not null and cosine at least ``threshold``.  Vectors that are null, empty
    or zero, or hold null or non-finite components link with nothing, nor do vectors of different sizes.  Rows that share an id
    are vectors of their own, in one component.  A null id is not kept.  Other columns are ignored.
    """
    kind = df.schema[vector].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = df.select(df[vec_id].cast("long").alias("id"), df[label].alias("label"), df[vector].cast(f"array<{kind}>").alias("v"))
    good = "label is not null and id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    rows = rows.withColumn("good", F.coalesce(F.expr(good), F.lit(False)))
    classes = rows.filter("good").groupBy("label", "v").agg(F.min("id").alias("cls"), F.count("*").alias("mult"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    n = classes.count()
    coded = written(_codes(classes.withColumn("dim", F.size("v")), words_for(n, s), s), "vector-codes")
    crowds = written(coded.select("dim", "label", F.explode("fs").alias("f")).groupBy("dim", "label", "f").count().filter("count > 1"), "vector-crowds")
    balls = written(_balls(coded, crowds, s), "vector-balls")
    placed = _placed(coded, crowds, balls, s)
    full = placed.join(coded.select("cid", "dim", "label", "cls", "mult", "v", "fs"), "cid").withColumn("earlier", F.expr("filter(fs, e -> e < f)")).drop("fs")
    sorted_ = full.repartition("dim", "label", "f", "lo", "hi").sortWithinPartitions("dim", "label", "f", "lo", "hi")
    found = written(sorted_.mapInArrow(_compare(s), "cid long, cls long, links long, near long").unionByName(_counted(balls)), "vector-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("near").alias("a"), F.col("cls").alias("b")).filter("a <> b").distinct()
    labels = components(edges)
    known = classes.join(links, "cid", "left").join(labels.withColumnRenamed("id", "cls"), "cls", "left")
    known = known.select("label", "v", "cls", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component_id"), F.col("mult").alias("k"))
    out = join_known(rows.filter("good"), known, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.filter("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))

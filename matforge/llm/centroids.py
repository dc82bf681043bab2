"""Centroid clustering in exact integers, screened in float32.

A batch of vectors meets all centroids in one float32 matrix product.  Every product has a rigorous bound on its rounding error,
so each squared distance is known to lie in an interval; centroids whose interval begins beyond the end of another are out.
Where one is left it is the nearest; where several are, their distances are computed again with integers, and ties go to the
smaller number.  Sums of clusters are integers too, so results do not depend on how the vectors are dealt to tasks.

Every round is one pass over the table without a shuffle of vectors: a task gives one partial sum for each cluster and
component, and the driver reads ``clusters * dim`` sums, however many vectors there are.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 2.0**-24  # relative rounding error of float32
SMALL = 1 << 26  # integers below it are kept in 64 bits; larger ones as Python's, of any size
LIMB = 32  # bits in which sums travel
LONG = 1 << 63


def integers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and the kept ones as integers ``floor(scale * x)``.

    A row is kept if it has ``dim`` components, none of them null or not finite (before or after scaling).
    """
    n = len(column)
    right = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False), bool)
    rows = np.flatnonzero(right)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(flat * scale)
    fine = np.isfinite(x).all(axis=1)
    keep = np.zeros(n, bool)
    keep[rows[fine]] = True
    return keep, exact(x[fine])


def exact(x: np.ndarray) -> np.ndarray:
    """Whole numbers as 64-bit integers if they are small, else as Python's."""
    if x.size and np.abs(x).max() >= SMALL:
        return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    return x.astype(np.int64)


def screened(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest to which vectors; at least one in each row, always the true one among them."""
    dim = x.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        dots = (xf.astype(np.float32) @ cf.astype(np.float32).T).astype(np.float64)
        squares = (cf * cf).sum(axis=1)
        lengths = np.sqrt((xf * xf).sum(axis=1))[:, None] * np.sqrt(squares)
        n = dim + 3  # a sum of ``dim`` products in any order, and both factors rounded to float32
        gamma = n * UNIT / (1 - n * UNIT)
        # |x . c| summed by magnitude is at most the product of the lengths; the second part covers float64
        error = 2 * gamma * lengths * (1 + 1e-9) + (dim + 8) * 2.0**-52 * (squares + lengths)
        middle = squares - 2 * dots  # squared distance less the square of x
        low, high = middle - error, middle + error
        out = low > high.min(axis=1, keepdims=True)
    out[~np.isfinite(low).all(axis=1)] = False  # beyond float32: nothing is known
    return ~out


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances row by row."""
    d = x - c
    if d.dtype != object and d.shape[1] > 512:
        d = d.astype(object)
    return (d * d).sum(axis=1)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector (ties: the smaller one), and the squared distance, both exact."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    may = screened(x, c)
    cluster = may.argmax(axis=1)
    open_ = np.flatnonzero(may.sum(axis=1) > 1)
    if len(open_):
        i, j = np.nonzero(may[open_])
        d = squared(x[open_[i]], c[j])
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        least = np.minimum.reduceat(d, starts)
        hit = np.flatnonzero((d == least[i]).astype(bool))  # in order of row and number
        row, first = np.unique(i[hit], return_index=True)
        cluster[open_[row]] = j[hit[first]]
    return cluster, squared(x, c[cluster])


def _matrix(rows: list[list[int]], dim: int) -> np.ndarray:
    big = any(abs(v) >= SMALL for r in rows for v in r)
    return np.array(rows, dtype=object if big else np.int64).reshape(len(rows), dim)


def _starts(vectors: DataFrame, clusters: int, dim: int, scale: int, seed: str) -> list[list[int]]:
    """The ``clusters`` kept vectors of smallest hash (ties, of repeated ids: by components); vectors without an id are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[int]]] = []
        for b in batches:
            keep, x = integers(b.column(1), dim, scale)
            ids = b.column(0).filter(pa.array(keep)).to_pylist()
            hashed = ((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), k) for k, i in enumerate(ids) if i is not None)
            best = heapq.nsmallest(clusters, best + [(h, x[k].tolist()) for h, k in heapq.nsmallest(clusters, hashed, key=lambda e: (e[0], x[e[1]].tolist()))])
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.string()), pa.array([[str(v) for v in r] for _, r in best], pa.list_(pa.string()))], ["h", "v"])

    found = vectors.mapInArrow(run, "h string, v array<string>").withColumn("n", F.transform("v", lambda s: s.cast("double")))  # exact: they were doubles
    return [[int(s) for s in r["v"]] for r in found.orderBy("h", "n").limit(clusters).collect()]


def _means(vectors: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> list[list[int]]:
    """Each centroid as the exact floor of its vectors' mean; without vectors it stays."""
    c = _matrix(centroids, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        counts: dict[int, int] = {}
        for b in batches:
            _, x = integers(b.column(1), dim, scale)
            cluster, _ = nearest(x, c)
            for k in np.unique(cluster).tolist():
                own = x[cluster == k]
                counts[k] = counts.get(k, 0) + len(own)
                sums[k] = [a + v for a, v in zip(sums.get(k, [0] * dim), own.sum(axis=0).tolist())]
        rows = [(k, -1, 0, n) for k, n in counts.items()]
        for k, values in sums.items():
            for i, v in enumerate(values):
                limb = 0
                while not -(1 << LIMB - 1) <= v < 1 << LIMB - 1:
                    rows.append((k, i, limb, v & (1 << LIMB) - 1))
                    v >>= LIMB
                    limb += 1
                rows.append((k, i, limb, v))
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["k", "i", "limb", "s"])

    parts = vectors.mapInArrow(run, "k long, i long, limb long, s long").groupBy("k", "i", "limb").agg(F.sum("s").alias("s"))
    total: dict[tuple[int, int], int] = {}
    for r in parts.collect():  # clusters * (dim + 1) sums, of a few limbs each
        total[r["k"], r["i"]] = total.get((r["k"], r["i"]), 0) + (r["s"] << LIMB * r["limb"])
    return [[total[k, i] // total[k, -1] for i in range(dim)] if (k, -1) in total else row for k, row in enumerate(centroids)]


def _assigned(vectors: DataFrame, centroids: list[list[int]], dim: int, scale: int, totals: Callable[[int], tuple] | None = None) -> DataFrame:
    """``vec_id, cluster, distance`` and, with ``totals``, the columns that depend on the cluster only."""
    c = _matrix(centroids, dim)
    kind = [("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())]
    more = [("cluster_inertia", pa.int64()), ("inertia", pa.int64()), ("centroid_sha256", pa.string())] if totals else []
    schema = pa.schema(kind + more)
    by_cluster = [totals(k) for k in range(len(centroids))] if totals else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, x = integers(b.column(1), dim, scale)
            cluster, d = nearest(x, c)
            distance = pa.array([v if v < LONG else None for v in d.tolist()], pa.int64()) if d.dtype == object else pa.array(d, pa.int64())
            columns = [b.column(0).filter(pa.array(keep)).cast(pa.int64()), pa.array(cluster, pa.int32()), distance]
            for f, values in zip(more, zip(*by_cluster)):
                columns.append(pa.array(values, f[1]).take(pa.array(cluster, pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}
    return vectors.mapInArrow(run, ", ".join(f"{n} {names[t]}" for n, t in kind + more))


def cluster_vectors(vectors: DataFrame, clusters: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1", vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each kept vector, and the centroids.

    Vectors that are null, of another length, or hold a null or non-finite component are left out; other columns are ignored.
    Repeated ids are vectors of their own.  A vector without an id is assigned and counted, but begins no cluster.  Fewer
    vectors with ids than ``clusters`` give fewer centroids, none gives an empty result.  Equal distances go to the smaller
    number.  Components of any size are computed exactly; a distance or sum beyond 64 bits is null.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("v"), F.col(vector).alias("e"))
    centroids = _starts(rows, clusters, dim, scale, seed)
    if not centroids:
        return _assigned(rows.limit(0), [[0] * dim], dim, scale, lambda k: (0, 0, "")), []
    for _ in range(rounds):
        centroids = _means(rows, centroids, dim, scale)
    sums = _assigned(rows, centroids, dim, scale).groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()
    each = {r["cluster"]: None if r["lost"] else int(r["s"]) for r in sums}
    whole = None if None in each.values() else sum(each.values())
    fits = lambda v: v if v is not None and v < LONG else None
    digest = lambda k: hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()
    return _assigned(rows, centroids, dim, scale, lambda k: (fits(each.get(k, 0)), fits(whole), digest(k))), centroids

"""Clustering against a plain fold in Python's integers."""

import hashlib
import math
import random

import numpy as np

from matforge.llm import centroids


def plain(rows, clusters, rounds, dim, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    c = [v for _, v in seeds]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), k) for k, w in enumerate(c))
    for _ in range(rounds if c else 0):
        own = [[] for _ in c]
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(col) // len(g) for col in zip(*g)] if g else old for g, old in zip(own, c)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept] if c else []
    return sorted(out, key=str), c


def check(spark, rows, clusters=4, rounds=3, dim=3, scale=64):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    got, c = centroids.cluster_vectors(df, clusters, rounds, dim, scale)
    got = got.collect()
    want, wc = plain(rows, clusters, rounds, dim, scale)
    assert c == wc
    fits = lambda v: v if v < 1 << 63 else None
    assert sorted([(r["vec_id"], r["cluster"], r["distance"]) for r in got], key=str) == sorted([(i, k, fits(d)) for i, k, d in want], key=str)
    for r in got:
        mine = sum(d for _, k, d in want if k == r["cluster"])
        assert r["cluster_inertia"] == fits(mine)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest()
    return got


def test_random_and_odd_rows(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(3)]) for i in range(300)]
    rows += [(None, [0.5, 0.5, 0.5]), (900, None), (901, [1.0, 2.0]), (902, [1.0, None, 2.0]), (903, [1.0, float("nan"), 0.0]), (904, [float("inf"), 0.0, 0.0]), (7, [0.1, 0.2, 0.3]), (7, [0.1, 0.2, 0.3])]
    got = check(spark, rows)
    assert len(got) == 303


def test_ties_and_few_vectors(spark):
    check(spark, [(i, [float(i % 2), 0.0, 0.0]) for i in range(40)], clusters=16)
    check(spark, [(1, [1.0, 1.0, 1.0])], clusters=16)
    check(spark, [(i, [0.0, 0.0, 0.0]) for i in range(20)])
    assert check(spark, [(1, None)]) == []
    assert check(spark, [(None, [1.0, 1.0, 1.0])]) == []


def test_hot_vector(spark):
    rnd = random.Random(4)
    check(spark, [(i, [0.25, -0.25, 0.125] if i % 3 else [rnd.random() for _ in range(3)]) for i in range(600)])


def test_huge_components(spark):
    rnd = random.Random(5)
    check(spark, [(i, [rnd.gauss(0, 10.0 ** rnd.randrange(0, 30)) for _ in range(3)]) for i in range(60)])


def test_intervals_hold(spark):
    """The true nearest centroid is always among those screened, near ties included."""
    rng = np.random.default_rng(0)
    for spread in (1, 50, 3000, 1 << 25):
        c = rng.integers(-spread, spread + 1, (16, 64))
        middle = (c[rng.integers(0, 16, 500)] + c[rng.integers(0, 16, 500)]) // 2
        x = middle + rng.integers(-1, 2, middle.shape)
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert centroids.screened(x, c)[np.arange(500), d.argmin(axis=1)].all()
        k, got = centroids.nearest(x, c)
        assert (k == d.argmin(axis=1)).all() and (got == d.min(axis=1)).all()

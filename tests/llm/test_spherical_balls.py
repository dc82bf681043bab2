"""Crowds of near copies: counted in balls, equal to all pairs compared."""

import numpy as np
from pyspark.sql import functions as F

from matforge.llm import spherical


def crowd(rng, centre, n, noise):
    x = centre + noise * rng.normal(size=(n, len(centre))) / len(centre) ** 0.5
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(x, labels, t=0.98):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= t) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    reach = np.arange(len(x))
    while True:
        new = np.minimum(reach, np.where(near, reach[None, :], len(x)).min(1))
        if (new == reach).all():
            return near.sum(1), reach
        reach = new


def found(spark, x, labels, **settings):
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels))], "vec_id long, embedding array<double>, label int")
    rows = spherical.near_vectors(df, spherical.Settings(**settings)).orderBy("vec_id").collect()
    return np.array([r["n_links"] for r in rows]), np.array([r["component_id"] for r in rows])


def test_crowds_equal_all_pairs(spark):
    """One tight crowd, one at the border of the radius, two that touch, the same crowd under another label, exact copies."""
    rng = np.random.default_rng(3)
    a, b = (v / np.linalg.norm(v) for v in rng.normal(size=(2, 64)))
    c = 0.975 * a + (1 - 0.975**2) ** 0.5 * b / np.linalg.norm(b)
    parts = [crowd(rng, a, 300, 0.03), crowd(rng, b, 200, 0.12), crowd(rng, c, 150, 0.1), crowd(rng, a, 60, 0.05), crowd(rng, -b, 80, 0.2), rng.normal(size=(300, 64))]
    x = np.concatenate(parts)
    x = np.concatenate([x, x[:40], x[:40]])
    labels = np.zeros(len(x), int)
    labels[650:710] = 1
    order = rng.permutation(len(x))
    x, labels = x[order], labels[order]
    links, component = found(spark, x, labels, block=64)
    want, reach = brute(x, labels)
    assert (links == want).all() and (component == reach).all()


def test_one_crowd_is_not_compared(spark):
    """20,000 near copies of one vector: no pair of blocks is left to compare."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    x = crowd(rng, centre / np.linalg.norm(centre), 20_000, 0.02)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    rows = spherical.near_vectors(df).agg(F.min("n_links"), F.max("n_links"), F.max("component_id"), F.count("*")).first()
    assert tuple(rows) == (19_999, 19_999, 0, 20_000)


def test_rows_that_share_an_id_are_vectors_of_their_own(spark):
    e, f = [1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6
    near_e = [1.0, 0.01] + [0.0] * 6
    rows = [(1, e, 0), (1, f, 0), (2, near_e, 0), (3, [0.01, 1.0] + [0.0] * 6, 0), (4, near_e, 0)]
    got = spherical.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 2, 1)]


def test_sizes_of_components_do_not_matter(spark):
    """Huge and tiny vectors have angles like others."""
    rows = [(1, [1e300, 1e298], 0), (2, [1e-300, 1e-302], 0), (3, [2.0, 0.02], 0), (4, [-1e300, 1.0], 0)]
    got = spherical.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)]

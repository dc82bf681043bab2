"""The learned encoder against a singular value decomposition, and what it finds beside hashed counts."""

import numpy as np
from pyspark.sql import functions as F

from matforge.functions import similarity
from matforge.operators import candidates, encoder


def test_subspace_is_that_of_the_largest_singular_values(spark):
    kinds = ["gate valve {} inch", "ball valve {} in", "flange {} raised face", "pump {} hp", "motor {} rpm 415v", "gasket {} spiral wound"]
    texts = [kinds[i % 6].format(i % 17) for i in range(240)] + [None, "", "gate valve 1 inch"]
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, clean_description string").repartition(5)
    s = encoder.Settings(dim=6, buckets=1 << 10, rounds=12, block=100)
    learned = encoder.learn(df, s=s)
    rarity, factor = learned.shipped.value
    known, x = encoder.Rows(s, rarity).dense([t or "" for t in texts])
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    # both bases span one space: the cosines of the angles between them are 1
    cosines = np.linalg.svd(vt[:6] @ factor[known].astype(float), compute_uv=False)
    assert cosines.min() > 0.99
    got = learned()(["gate valve 1 inch", "", "gate valve 1 inch"])
    assert np.allclose(got[0], got[2]) and np.isclose(np.linalg.norm(got[0]), 1, atol=1e-5) and not got[1].any()


def test_neighbours_hold_the_same_items(spark):
    """Share of the pairs of one item (described by two organisations) among the 15 nearest: at least that of hashed counts."""
    from matforge.plans import queries

    rows = {r["encoder"]: r["found"] / r["pairs"] for r in queries.QUERIES["encoder_recall"](spark, "/root/testdata/sf0.001").collect()}
    assert rows["learned"] >= rows["hashed"] > 0.1


def test_empty_catalog(spark):
    df = spark.createDataFrame([], "ord long, clean_description string")
    assert not encoder.learn(df, s=encoder.Settings(dim=4, buckets=64, rounds=1))()(["x"]).shape[0] == 0
    vec = spark.createDataFrame([(1, "gate"), (2, "gate")], "id long, t string").select("id", similarity.encode("t", encoder.learn(spark.createDataFrame([("gate",)], "clean_description string"), s=encoder.Settings(dim=4, buckets=64))).alias("v"))
    assert candidates.nearest(vec, 1, "id", "v").select(F.round("similarity", 5)).first()[0] == 1

"""Searches through the index against the same searches without it."""

import random

import pytest
from pyspark.sql import functions as F

from matforge.operators import analytics, postings


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(3)
    words = ["Gate", "valve", "50%", "a_b", "Ünit", "CS", "x\\y", "pump", "150#", "日本語"]
    text = lambda: " ".join(rnd.choices(words, k=rnd.randrange(0, 5)))
    items = spark.createDataFrame([(i, f"I-{i % 37}", rnd.choice(["SAIL", "ONGC", None]), text() if i % 9 else None, text()) for i in range(300)], "ord long, item_id string, source_cpse string, clean_description string, raw_description string").persist()
    reg = spark.createDataFrame([(f"CNMC-{i:06d}", text() or None) for i in range(150)], "cnmc_code string, canonical_description string").persist()
    mapping = spark.createDataFrame([(f"CNMC-{rnd.randrange(160):06d}", rnd.choice("AB"), f"MC{rnd.randrange(400)}", i) for i in range(400)], "cnmc_code string, source_cpse string, original_code string, id long").persist()
    return items, reg, mapping, analytics.catalog_index(items), analytics.registry_index(reg, mapping)


@pytest.mark.parametrize("q", ["gate valve", "VALVE", "50%", "a_b", "va", "", "ünit", "日本語", "I-3", "no such thing", "x\\y"])
def test_catalog(tables, q):
    items, _, _, index, _ = tables
    key = lambda df: sorted(r["ord"] for r in df.collect())
    assert key(analytics.filter_catalog(items, None, q, index)) == key(analytics.filter_catalog(items, None, q))
    assert key(analytics.filter_catalog(items, "sail", q, index)) == key(analytics.filter_catalog(items, "sail", q))


@pytest.mark.parametrize("q", ["gate%cs", "alv", "000_1", "MC1_3", "CNMC-00014", "50\\%", "a\\_b", "%", "_", "g_te v%pum", "none of it"])
def test_registry(tables, q):
    items, reg, mapping, catalog, codes = tables
    one, two = (analytics.search(reg, mapping, items, q, i) for i in ((codes, catalog), (None, None)))
    for a, b in zip(one, two):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_runs():
    assert postings.literal_runs("ab%c_d\\%e") == ["ab", "c", "d%e"]
    assert postings.literal_runs("%_") == []


def test_look_up_narrows(tables):
    items, _, _, index, _ = tables
    assert 0 < index.candidates(["gate valve"]).count() < items.count() / 2
    assert index.candidates(["ab"]) is None


def test_copies_add_no_postings(spark):
    """A text is posted once, however many rows have it, and all of them are found."""
    rows = spark.range(300).select("id", F.expr("CASE WHEN id % 3 = 0 THEN 'gate valve' ELSE 'pump' END").alias("t"))
    index = postings.build((rows, "id", ["t"]))
    assert index.postings.count() == 8 + 2
    assert sorted(r["id"] for r in index.narrowed(rows, "id", ["Valve"]).collect()) == list(range(0, 300, 3))

"""Pairs of two items, end to end, and pieces of the similarity."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matforge.functions import similarity
from matforge.operators import candidates
from matforge.plans import matching


CASES = {
    "exact": ('Gate Valve 4" CS Class 150', "4 Inch Gate Valve Carbon Steel 150#", None, None),
    "pressure": ("Gate Valve DN100 CS Class 150", "Gate Valve DN100 CS Class 600", "safety_gate_blocked", "Pressure class mismatch"),
    "size": ('Gate Valve 4" CS Class 150', 'Gate Valve 6" CS Class 150', "safety_gate_blocked", "Size mismatch"),
    "material": ('Gate Valve 4" CS Class 150', 'Gate Valve 4" SS316 Class 150', "safety_gate_blocked", "Material incompatibility"),
    "rpm": ("Induction Motor 5HP 2900 RPM", "Induction Motor 5HP 1440 RPM", "safety_gate_blocked", "speed_rpm mismatch"),
    "power": ("Centrifugal Pump 5HP 415V", "Centrifugal Pump 15HP 415V", "safety_gate_blocked", "power_hp mismatch"),
    "schedule": ('Seamless Pipe 4" SCH 40', 'Seamless Pipe 4" SCH 80', "safety_gate_blocked", "Schedule mismatch"),
    "missing": ('Gate Valve 4" Class 150 A105', 'Gate Valve 4" A105', "needs_review", "pressure_rating"),
    "subtype": ('Gate Valve 4" CS', 'Butterfly Valve 4" CS', "safety_gate_blocked", "Subtype conflict"),
    "category": ('Flange WN 4" 150#', 'Gate Valve 4" 150#', None, None),
}


@pytest.fixture(scope="module")
def matches(spark):
    rows = [(10 * i + j, f"{c}-{s}", f"{s}-{name}", d, "EA") for i, (name, (a, b, *_)) in enumerate(CASES.items()) for j, (c, s, d) in enumerate((("A", name, a), ("B", name, b)))]
    items = spark.createDataFrame(rows, "ord long, item_id string, cpse string, description string, uom string").withColumn("source_cpse", F.concat(F.substring("item_id", 1, 1), F.lit("CPSE")))
    found = matching.run(items.drop("cpse"), strategy="blocked").collect()
    return {r["item_a"][2:]: r for r in found if r["item_a"][2:] == r["item_b"][2:]}


@pytest.mark.parametrize("name", [n for n, c in CASES.items() if c[2]])
def test_decisions(matches, name):
    r = matches[name]
    assert r["status"] == CASES[name][2]
    assert CASES[name][3] in r["block_reason"]


def test_exact(matches):
    r = matches["exact"]
    assert r["status"] in ("auto_linked", "needs_review") and r["confidence_score"] >= 0.75
    assert r["explanation"]["critical_conflicts_count"] == 0 and r["explanation"]["technical_score_pct"] >= 80
    assert {d["attribute"] for d in r["explanation"]["spec_details"]} == {"category", "subtype", "size", "pressure_rating", "material_grade"}


def test_other_categories_do_not_meet(matches):
    assert "category" not in matches


def test_token_ratios():
    assert similarity.lcs_lengths(["kitten"], ["sitting"]).tolist() == [4]
    assert similarity.token_sort_ratios(["b a"], ["a b"]).tolist() == [1]
    assert similarity.token_set_ratios(["gate valve", ""], ["gate valve 4 inch", "x"]).tolist() == [1, 0]
    assert math.isclose(similarity.ratios(["abcd"], ["abxd"])[0], 0.75)


def test_ngram_cosine(spark):
    df = spark.createDataFrame([("ab", "ab"), ("ab", "xy"), ("ab ab", "ab"), ("", "ab")], "a string, b string")
    got = [r[0] for r in df.select(similarity.grams("a").alias("x"), similarity.grams("b").alias("y")).select(similarity.pair_tfidf("x", "y")).collect()]
    assert [round(g, 6) for g in got] == [1.0, 0.0, 1.0, 0.0]


def test_nearest(spark):
    x = np.random.default_rng(1).normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>")
    got = {(r["id"], r["rank"]): r["neighbour"] for r in candidates.nearest(df, 3, block=16).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert got == {(i, k + 1): j for i in range(60) for k, j in enumerate(np.argsort(-s[i])[:3])}

"""Minting, review and exports."""

from datetime import datetime

import pytest

from matforge.operators import analytics, registry

AT = datetime(2024, 1, 2)
SCHEMA = "ord long, match_id string, item_a string, item_b string, source_cpse_a string, source_cpse_b string, canonical_description string, confidence_score double, status string, block_reason string"


def matches(spark, *rows):
    return spark.createDataFrame([(i, f"M-{a}-{b}", a, b, a[0], b[0], f"d {a}", c, s, "r" if s == "safety_gate_blocked" else None) for i, (a, b, c, s) in enumerate(rows)], SCHEMA)


def codes(t):
    return {r["original_code"]: r["cnmc_code"] for r in t.mapping.collect()}


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([(i, f"{c}{n}", c, f"clean {c}{n}") for i, (c, n) in enumerate((c, n) for c in "ABC" for n in range(4))], "ord long, item_id string, source_cpse string, clean_description string")


def test_fold(spark):
    m = matches(spark, ("A1", "B1", 0.9, "auto_linked"), ("A2", "B2", 0.9, "auto_linked"), ("B1", "C1", 0.8, "auto_linked"), ("A1", "A2", 0.8, "auto_linked"))
    t = registry.mint(registry.empty(spark), m, "auto_linked", "x", AT)
    # the last match joins nothing, though its items have different codes
    assert codes(t) == {"A1": "CNMC-000001", "B1": "CNMC-000001", "A2": "CNMC-000002", "B2": "CNMC-000002", "C1": "CNMC-000001"}
    assert t.audit.count() == 3 and t.registry.count() == 2
    again = registry.mint(t, matches(spark, ("A3", "C1", 0.9, "auto_linked"), ("A0", "B0", 0.9, "auto_linked")), "human_approved", "y", AT)
    assert codes(again)["A3"] == "CNMC-000001" and codes(again)["A0"] == "CNMC-000003"
    assert registry.violations(again).isEmpty()


def test_integrate_and_review(spark, catalog):
    m = matches(spark, ("A1", "B1", 0.9, "auto_linked"), ("A2", "B2", 0.7, "needs_review"), ("A3", "B3", 0.9, "safety_gate_blocked"), ("A0", "B0", 0.75, "needs_review"))
    t, _ = registry.integrate(registry.empty(spark), m, catalog, AT)
    assert sorted(r["action"] for r in t.audit.collect()) == ["auto_linked", "safety_gate_blocked"]
    with pytest.raises(ValueError):
        registry.decide(t, m, catalog, "M-A3-B3", "approved", "r", AT)
    with pytest.raises(KeyError):
        registry.decide(t, m, catalog, "M-none", "approved", "r", AT)
    t = registry.decide(t, m, catalog, "M-A2-B2", "rejected", "r", AT, "no")
    queue = {r["match_id"]: r["status"] for r in registry.pending(m, catalog, t.mapping, t.decisions).collect()}
    assert queue == {"M-A1-B1": "human_approved", "M-A2-B2": "human_rejected", "M-A3-B3": "safety_gate_blocked", "M-A0-B0": "needs_review"}
    after = registry.batch_approve(t, m, catalog, AT)
    assert "A2" not in codes(after) and codes(after)["A0"] == "CNMC-000002"
    assert "A2" in codes(registry.batch_approve(t, m, catalog, AT, compat=True))
    out = analytics.audit_export(after.audit).collect()
    assert {r["REASON_OR_NOTES"] for r in out} == {"", "r", "no"}


def test_missing_item(spark, catalog):
    with pytest.raises(KeyError):
        registry.integrate(registry.empty(spark), matches(spark, ("A1", "Z9", 0.9, "auto_linked")), catalog, AT)


def test_codes_beyond_six_digits(spark):
    reg = spark.createDataFrame([("CNMC-999999",), ("CNMC-1000000",), ("CNMC-x",)], "cnmc_code string")
    assert registry.next_number(reg) == 1000001


def test_numbered_is_in_order(spark):
    """Numbers follow the order without gaps or repeats, whichever way the rows lie."""
    rows = spark.range(3000).selectExpr("pmod(xxhash64(id), 100000000) * 3000 + id AS ord").repartition(7)
    got = sorted((r["number"], r["ord"]) for r in registry.numbered(rows, 5).collect())
    assert [n for n, _ in got] == list(range(5, 3005)) and [o for _, o in got] == sorted(o for _, o in got)
    assert registry.numbered(rows.limit(0), 1).count() == 0

"""Tables of decisions against decisions taken one after the other, and the order of results."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from matforge.operators import analytics, registry

from .test_registry import AT, catalog, codes, matches  # noqa: F401

ASKED = "match_id string, decision string, reviewer_id string, reviewed_at timestamp, notes string"


def later(n):
    return AT + timedelta(minutes=n)


@pytest.fixture(scope="module")
def queue(spark):
    return matches(spark, ("A1", "B1", 0.9, "needs_review"), ("A2", "B2", 0.7, "needs_review"), ("A3", "B3", 0.9, "safety_gate_blocked"), ("A0", "B0", 0.75, "needs_review"), ("B1", "C1", 0.8, "needs_review"), ("A2", "A1", 0.6, "needs_review")).cache()


def test_table_of_decisions_as_one_by_one(spark, catalog, queue):  # noqa: F811
    asked = [
        ("M-B1-C1", "approved", "r1", later(1), None),
        ("M-A1-B1", "\tApproved ", "r2", later(2), "same"),  # joins the code that B1 has by then
        ("M-A3-B3", "rejected", "r1", later(3), "other class"),  # a blocked match can be rejected
        ("M-A2-B2", "rejected", "r1", later(4), None),
        ("M-A2-B2", "approved", "r3", later(5), None),  # another view, later
        ("M-A2-A1", "approved", "r3", later(6), None),  # both have codes: kept apart, nothing recorded but the decision
    ]
    one = registry.empty(spark)
    for m, d, r, at, n in asked:
        one = registry.decide(one, queue, catalog, m, d.strip(), r, at, n)
    bad = [("M-A3-B3", "approved", "r", later(7), None), ("M-none", "approved", "r", later(8), None), (None, "approved", "r", None, None), ("M-A0-B0", "perhaps", "r", later(9), None), ("M-A0-B0", None, "r", later(9), None)]
    t, refused = registry.decide_all(registry.empty(spark), queue, catalog, spark.createDataFrame([*bad, *reversed(asked)], ASKED), AT)
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    assert codes(t) == codes(one) == {"B1": "CNMC-000001", "C1": "CNMC-000001", "A1": "CNMC-000001", "A2": "CNMC-000002", "B2": "CNMC-000002"}
    for name in ("registry", "mapping"):
        assert rows(getattr(t, name), *[c for c in getattr(t, name).columns if c != "created_at"]) == rows(getattr(one, name), *[c for c in getattr(one, name).columns if c != "created_at"])
    trail = ("entry_id", "cnmc_code", "action", "actor", "details", "timestamp")
    assert rows(t.audit, *trail) == rows(one.audit, *trail)
    assert rows(t.decisions, "match_id", "decision", "reviewer_id", "notes") == rows(one.decisions, "match_id", "decision", "reviewer_id", "notes")
    told = sorted((str(r["match_id"]), str(r["decision"]), r["reason"].split()[0]) for r in refused.collect())
    assert told == [("M-A0-B0", "None", "a"), ("M-A0-B0", "perhaps", "a"), ("M-A3-B3", "approved", "a"), ("M-none", "approved", "match"), ("None", "approved", "match")]
    assert registry.violations(t).isEmpty()


def test_no_decisions_and_empty_queue(spark, catalog, queue):  # noqa: F811
    none = spark.createDataFrame([], ASKED)
    t, refused = registry.decide_all(registry.empty(spark), queue, catalog, none, AT)
    assert t.audit.isEmpty() and t.decisions.isEmpty() and refused.isEmpty()
    t, refused = registry.decide_all(registry.empty(spark), queue.limit(0), catalog, spark.createDataFrame([("M-A1-B1", "approved", "r", None, None)], ASKED), AT)
    assert t.registry.isEmpty() and [r["reason"] for r in refused.collect()] == ["match is not known"]


def test_unknown_item_stops_the_table(spark, catalog):  # noqa: F811
    with pytest.raises(KeyError):
        registry.decide_all(registry.empty(spark), matches(spark, ("A1", "Z9", 0.9, "needs_review")), catalog, spark.createDataFrame([("M-A1-Z9", "approved", "r", None, None)], ASKED), AT)


def test_batch_approval_says_why(spark, catalog, queue):  # noqa: F811
    t = registry.batch_approve(registry.empty(spark), queue, catalog, AT, 0.75)
    assert {r["match_id"]: r["notes"] for r in t.decisions.collect()} == {"M-A1-B1": "Batch approved (Confidence 0.9)", "M-A0-B0": "Batch approved (Confidence 0.75)", "M-B1-C1": "Batch approved (Confidence 0.8)"}


def test_order_and_window_of_listings(spark):
    """Codes and audit entries come newest first, ties by code upwards and by entry downwards; both ends of a window count."""
    reg = spark.range(40).select(registry.code_of(F.col("id")).alias("cnmc_code"), F.concat(F.lit("d"), "id").alias("canonical_description"), F.timestamp_seconds(F.col("id") % 7 * 3600 + 1704067200).cast("timestamp_ntz").alias("created_at")).repartition(5)
    mapping = spark.createDataFrame([], registry.MAPPING)
    start, end = datetime(2024, 1, 1, 2), datetime(2024, 1, 1, 5)
    got = [(r["created_at"], r["cnmc_code"]) for r in analytics.filter_registry(reg, mapping, start=start, end=end).collect()]
    assert got == sorted(got, key=lambda x: (-x[0].timestamp(), x[1])) and {t.hour for t, _ in got} == {2, 3, 4, 5} and len(got) == 23
    audit = spark.range(60).select(F.col("id").alias("entry_id"), F.expr("CASE WHEN id % 2 = 0 THEN 'auto_linked' ELSE 'human_approved' END").alias("action"), F.timestamp_seconds(F.col("id") % 5).alias("timestamp")).repartition(4)
    got = [(r["timestamp"], r["entry_id"]) for r in analytics.filter_audit(audit, "auto_linked").collect()]
    assert got == sorted(got, reverse=True) and len(got) == 30


@pytest.mark.parametrize("status", [None, "safety_blocked", "needs_review", "human_rejected"])
def test_queue_of_matches_that_carry_their_decision(spark, catalog, queue, status):  # noqa: F811
    """The same queue as with a table of decisions; without one, matches are not dealt by their ids."""
    told = {"M-A1-B1": "rejected", "M-A3-B3": "approved", "M-A0-B0": "rejected"}
    decisions = spark.createDataFrame([(m, d, AT) for m, d in told.items()], "match_id string, decision string, reviewed_at timestamp")
    mapping = spark.createDataFrame([(1, "CNMC-000001", "SAIL", "A2"), (2, "CNMC-000001", "ONGC", "B2")], registry.MAPPING)
    carried = queue.withColumn("decided", F.create_map(*[F.lit(x) for kv in told.items() for x in kv])[F.col("match_id")])
    rows = lambda m, d: sorted((r["match_id"], r["status"], str(r["cnmc_code"]), str(r["mappings"]), r["description_a"]) for r in registry.pending(m, catalog, mapping, d, status).collect())
    got = rows(carried, None)
    assert got == rows(queue, decisions) and got != [] if status != "safety_blocked" else got == rows(queue, decisions) == []


def test_matches_are_decided_once_for_each_two_wordings(spark, monkeypatch):
    """The catalog repeats its wordings, so far fewer pairs are evaluated than there are matches."""
    from matforge.plans import queries

    seen, evaluate = [], queries.gate.evaluate
    monkeypatch.setattr(queries.gate, "evaluate", lambda pairs: seen.append(pairs) or evaluate(pairs))
    matches, _ = queries._halves(spark, "/root/testdata/sf0.01")
    assert matches.count() == 1000 and seen[0].count() < 500


@pytest.mark.parametrize("name", ["pending_blocked", "pending_queue"])
def test_queue_looks_nothing_up_for_a_match(spark, name):
    """Items have their codes before pairs are written out: no pair is joined or dealt afterwards."""
    from matforge.plans import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    above = plan[: plan.rindex("Generate inline")]
    assert plan.count("Generate inline") == 2 and "Join" not in above and "Exchange" not in above

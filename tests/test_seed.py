"""The pilot catalog end to end, the trial decisions, and catalogs of several files."""

from datetime import datetime

from matforge.operators import registry
from matforge.sources import catalogs, seed

AT = datetime(2024, 1, 2)


def test_pilot_catalog(spark):
    rows = {r["item_id"]: r for r in seed.pilot_catalog(spark).collect()}
    assert len(rows) == 44 and {r["source_cpse"] for r in rows.values()} == {"ONGC", "SAIL", "IOCL", "GAIL"}
    valve = rows["GAIL-VLV-412"]
    assert valve["specs"]["size"] == "DN150" and valve["specs"]["pressure_rating"] == "CL150" and valve["unit_of_measure"] == "EA"
    assert valve["category_hint"] is None and valve["specs"]["category"] == "VALVE"


def test_reload_matches_and_mints(spark, tmp_path):
    tables, catalog, matches = seed.reload(spark, str(tmp_path), AT)
    by_pair = {frozenset((r["item_a"], r["item_b"])): r for r in matches.collect()}
    assert by_pair and all(a[:4] != b[:4] for a, b in map(tuple, by_pair))
    # the same item in two phrasings is never blocked; another size or class always is
    assert by_pair[frozenset(("ONGC-GSK-121", "SAIL-GSK-221"))]["status"] in ("auto_linked", "needs_review")
    assert by_pair[frozenset(("ONGC-GSK-121", "IOCL-GSK-322"))]["status"] == "safety_gate_blocked"
    linked = [r for r in by_pair.values() if r["status"] == "auto_linked"]
    blocked = [r for r in by_pair.values() if r["status"] == "safety_gate_blocked"]
    codes = {r["original_code"]: r["cnmc_code"] for r in tables.mapping.collect()}
    assert linked and {x for r in linked for x in (r["item_a"], r["item_b"])} == codes.keys()
    assert sorted(set(codes.values())) == [f"CNMC-{i:06d}" for i in range(1, tables.registry.count() + 1)]
    actions = [r["action"] for r in tables.audit.collect()]
    assert actions.count("safety_gate_blocked") == len(blocked) and registry.violations(tables).isEmpty()
    # starting over gives the same tables
    again, _, _ = seed.reload(spark, str(tmp_path), AT)
    assert {r["original_code"]: r["cnmc_code"] for r in again.mapping.collect()} == codes and catalog.count() == 44


def test_trial_decisions(spark):
    t = seed.trial_decisions(registry.empty(spark), AT)
    assert {(r["cnmc_code"], r["source_cpse"], r["original_code"]) for r in t.mapping.collect()} == {("CNMC-000001", "GAIL", "GAIL-V210"), ("CNMC-000001", "OIL", "OIL-V300")}
    assert sorted((r["action"], r["actor"], r["cnmc_code"]) for r in t.audit.collect()) == [("human_approved", "reviewer_demo", "CNMC-000001"), ("safety_gate_blocked", "system", None)]


def test_order_over_files(spark, tmp_path):
    for name, rows in (("b.csv", 3), ("a.csv", 2)):
        (tmp_path / name).write_text("material_code,material_description,uom\n" + "".join(f"{name[0]}{i},Gate Valve {i} inch CS,EA\n" for i in range(rows)))
    got = [(r["ord"], r["item_id"]) for r in catalogs.read_catalog(spark, str(tmp_path), "X").orderBy("ord").collect()]
    assert [i for _, i in got] == ["X-a0", "X-a1", "X-b0", "X-b1", "X-b2"] and len({o for o, _ in got}) == 5

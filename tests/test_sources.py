"""Catalog files: dialects, validation, logs."""

import pytest
from pyspark.sql import functions as F

from matforge.sources import catalogs


def load(spark, content, cpse="ONGC"):
    rows = catalogs.rows_of_bytes(spark, content)
    return catalogs.standardized(rows, cpse).orderBy("ord").collect(), catalogs.report(rows, cpse).first()


HEAD = b"material_code,material_description,uom\n"


@pytest.mark.parametrize(
    "content",
    [
        b"material_code,material_description,uom,plant\nA1,Gate Valve,NOS,P1\nA2,Pump 5HP,EA,P1\n",
        b"material_code;material_description;uom;plant\nA1;Gate Valve;NOS;P1\nA2;Pump 5HP;EA;P1\n",
        b"material_code\tmaterial_description\tuom\tplant\nA1\tGate Valve\tNOS\tP1\nA2\tPump 5HP\tEA\tP1\n",
        b"\xef\xbb\xbfmaterial_code,material_description,uom,plant\r\nA1,Gate Valve,NOS,P1\r\nA2,Pump 5HP,EA,P1\r\n",
        b"MATNR,MAKTX,MEINS,WERKS\nA1,Gate Valve,NOS,P1\nA2,Pump 5HP,EA,P1\n",
        b"material_code,material_description,uom,plant\n\nA1,Gate Valve,NOS,P1\n , , ,\nA2,Pump 5HP,EA,P1\n",
    ],
)
def test_dialects(spark, content):
    items, report = load(spark, content)
    assert [(r["item_id"], r["material_description"], r["unit_of_measure"], r["plant"]) for r in items] == [("ONGC-A1", "Gate Valve", "EA", "P1"), ("ONGC-A2", "Pump 5HP", "EA", "P1")]
    assert (report["total_rows"], report["valid_rows"], report["invalid_rows"]) == (2, 2, 0)


def test_quotes(spark):
    items, _ = load(spark, HEAD + b'A1,"Gate Valve, CS",EA\nA2,"Pump\n15 HP",EA\n')
    assert [r["material_description"] for r in items] == ["Gate Valve, CS", "Pump\n15 HP"]
    assert items[1]["specs"]["power_hp"] == "15 HP"


def test_errors(spark):
    items, report = load(spark, HEAD + b"A1,Gate Valve,EA\n,x,EA\nA3,,EA\nA4,x,\nA1,again,EA\n")
    assert [r["material_code"] for r in items] == ["A1"]
    assert [report[c] for c in ("total_rows", "valid_rows", "invalid_rows", "duplicate_source_rows", "missing_material_codes", "missing_descriptions", "missing_uom")] == [5, 1, 4, 1, 1, 1, 1]
    assert report["errors"][-1] == "Row 5: Duplicate source item 'A1' for CPSE 'ONGC'"


@pytest.mark.parametrize("content, error", [(b"", "CSV file is empty."), (b",,\n1,2,3\n", "CSV header is missing or empty."), (b"material_code,material_description\nA,x\n", "Missing mandatory column mapping for: uom")])
def test_broken_files(spark, content, error):
    items, report = load(spark, content)
    assert not items and report["errors"][0] == error


def test_codes(spark):
    items, _ = load(spark, b"description,unit\nGate Valve,EA\n", "SAIL")
    assert items[0]["item_id"] == "SAIL-MAT-001"
    items, _ = load(spark, HEAD + b"ongc-7,Gate Valve,EA\n")
    assert items[0]["item_id"] == "ongc-7"


def test_latin(spark):
    assert load(spark, HEAD + "A1,Düse,EA\n".encode("latin-1"))[0][0]["material_description"] == "Düse"


def test_column_mapping():
    assert catalogs.map_columns(["Material Code", "Item No", "Description", "x"]) == ({"Material Code": "material_code", "Description": "material_description"}, ["Item No", "x"])


def test_log(spark):
    lines = ["[BLOCKED by SAFETY GATE] confidence=0.91", "A: ONGC-1 (x)", "B: IOCL-2", "noise", "SAFETY GATE TRIGGERED: pressure", "A: ONGC-3", "SAFETY GATE TRIGGERED: no b"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    assert [tuple(r) for r in catalogs.blocked_of_log(df).collect()] == [("BLOCKED-ONGC-1-IOCL-2", "ONGC-1", "IOCL-2", 0.91, "safety_gate_blocked", "pressure")]


def test_keyed_jsonl(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"item_id":"a","v":1}\n\n{"item_id":"b","v":2}\n{"item_id":"a","v":3}\n')
    assert {r["item_id"]: r["v"] for r in catalogs.read_keyed_jsonl(spark, str(p)).collect()} == {"a": 3, "b": 2}
    assert catalogs.read_catalog(spark, _csv(tmp_path), "GAIL").select(F.max("source_cpse")).first()[0] == "GAIL"


def _csv(tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes(HEAD + b"A1,Gate Valve,EA\n")
    return str(p)

"""Canonical forms, classification and attributes."""

import pytest

from matforge.functions import specs, text
from matforge.functions.dialect import column


def one(spark, rule, value, **more):
    cols = {"v": value, **more}
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols))
    return df.select(column(rule)).first()[0]


def many(spark, rule, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", column(rule).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_sizes(spark):
    assert many(spark, text.size("v"), ['4"', "4 IN", "4 inch", "DN100", "100 NB"]) == ["DN100"] * 5
    assert many(spark, text.size("v"), ["1-1/2\"", "0.5", "25MM", "7 NB", "100.0", "04", "9", "3 foot", "", None]) == ["DN40", "DN15", "DN25", "DN7", "DN100", "DN100", "9", "3 FOOT", None, None]


def test_pressures(spark):
    assert many(spark, text.pressure("v"), ["CL.150", "Class 150", "150#", "PN 64", "777#", "high", None]) == ["CL150", "CL150", "CL150", "PN64", "CL777", "HIGH", None]


def test_power(spark):
    assert many(spark, text.power("v"), ["5HP", "3.7 kW", "2.5 kW", "7.50 HP", "15 kilowatt"]) == ["5 HP", "5 HP", "3.4 HP", "7.5 HP", "20 HP"]


def test_materials(spark):
    assert many(spark, text.material("v"), ["A216 WCB", "WCB", "SS", "Inconel", "MS", None])[:5] == ["A216_WCB|CARBON_STEEL|CARBON_STEEL"] * 2 + ["STAINLESS_STEEL|STAINLESS_STEEL_316|STAINLESS_STEEL", "INCONEL|INCONEL|INCONEL", "IS_2062_E250|CARBON_STEEL|CARBON_STEEL"]
    # a canonical name that is no alias stays itself
    assert one(spark, text.material_family("v"), "STAINLESS_STEEL") == "STAINLESS_STEEL"


def test_clean_and_units(spark):
    assert many(spark, text.clean("v"), ["VLV  GATE CS", "FLG WN RF", "NPT end"]) == ["Valve GATE Carbon Steel", "Flange Weld Neck Raised Face", "Screwed NPT end"]
    assert many(spark, text.unit("v"), [" nos ", "KGS", "furlong"]) == ["EA", "KG", "FURLONG"]
    assert one(spark, text.unit("v", "EA"), None) == "EA"


@pytest.mark.parametrize(
    "description, category, subtype",
    [
        ("Flange Gasket spiral wound", "GASKET", "SPIRAL_WOUND"),
        ("Pipe Elbow 4 inch", "FITTING", None),
        ("Pump motor 5HP", "MOTOR", None),
        ("Gate Valve 4 inch", "VALVE", "GATE_VALVE"),
        ("NRV 4IN", "VALVE", "CHECK_VALVE"),
        ("Angle Valve", "STRUCTURAL_STEEL", None),
        ("Safety helmet", "OTHER", None),
    ],
)
def test_categories(spark, description, category, subtype):
    df = spark.createDataFrame([(description,)], "v string").withColumn("category", column(text.category("v")))
    assert tuple(df.select("category", column(text.subtype("v", "category"))).first()) == (category, subtype)


def test_hint(spark):
    assert one(spark, text.category("v", "h"), "thing", h="pump") == "PUMP"
    assert one(spark, text.category("v", "h"), "gate valve", h="nonsense") == "VALVE"


def test_attributes(spark):
    rows = [("Gate Valve 4\" CS Class 150 RF API 6D",), ("Induction Motor 3.7 kW 2900 RPM 415V 3 Phase 50 Hz",), ("Bearing SKF 6205 2RS",), ("Seamless Pipe SCH 40 6 inch",)]
    df = spark.createDataFrame(rows, "description string")
    a, m, b, p = specs.extract(df).collect()
    assert (a["size"], a["pressure_rating"], a["material_grade"], a["facing"], a["standards"]) == ("DN100", "CL150", "CARBON_STEEL", "RF", "API 6D")
    assert (m["power_hp"], m["speed_rpm"], m["voltage"], m["phase"], m["frequency"]) == ("5 HP", "2900_RPM", "415V", "3_PHASE", "50HZ")
    assert (b["bearing_number"], b["clearance"]) == ("6205", "CN")
    assert p["schedule"] == "SCH_40"
    assert specs.extract(df, matching=True).collect()[1]["power_hp"] == "3.7 HP"

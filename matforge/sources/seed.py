"""The pilot catalog: a literal table of items of four organisations, and two decisions to try the registry with."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import specs, text
from ..functions.dialect import column
from ..operators import registry

# Item, organisation, description, unit.
PILOT = [
    ("ONGC-FLG-101", "ONGC", "Flange WN RF 150# ASTM A105 6IN ASME B16.5", "EA"),
    ("SAIL-FLG-201", "SAIL", "Weld Neck Flange, Raised Face, Class 150, Carbon Steel A105, 6 inch, per ASME B16.5", "EA"),
    ("IOCL-FLG-301", "IOCL", 'FLANGE WELDNECK RF CL.150 MAT: A105 SIZE: 6" SCH 40 STD ASME B16.5', "Nos"),
    ("GAIL-FLG-401", "GAIL", "6 INCH WELD NECK FLANGE 150 CLASS RAISED FACE ASTM A105 FOR GAS PIPELINE", "EA"),
    ("ONGC-FLG-102", "ONGC", "Slip-On Flange RF Class 300 SS A182 F316 4IN", "EA"),
    ("IOCL-FLG-302", "IOCL", "FLANGE SLIP ON RAISED FACE 300# STAINLESS STEEL 316 4 INCH", "PCS"),
    ("GAIL-FLG-402", "GAIL", "Flange SO RF 300# ASTM A182 F316 4IN ASME B16.5", "EA"),
    ("SAIL-FLG-202", "SAIL", "Blind Flange Class 150 Raised Face Carbon Steel A105 8 inch", "EA"),
    ("ONGC-FLG-103", "ONGC", "Flange Blind RF 150# ASTM A105 8IN ASME B16.5", "EA"),
    ("ONGC-VLV-111", "ONGC", "Ball Valve 2IN A105 800# Screwed End API 6D", "EA"),
    ("SAIL-VLV-211", "SAIL", "Valve, Ball Type, Carbon Steel A105, 2 inch, 800 class, Screwed End, API 6D compliant", "EA"),
    ("IOCL-VLV-311", "IOCL", 'BALL VALVE 2" 800# SCREWED NPT BODY ASTM A105 BALL SS316 API-6D', "Nos"),
    ("GAIL-VLV-411", "GAIL", "2 INCH BALL VALVE CLASS 800 FORGED CARBON STEEL A105 SCREWED ENDS TO API 6D", "EA"),
    ("ONGC-VLV-112", "ONGC", "Gate Valve 6IN 150# Flanged WCB API 600", "EA"),
    ("SAIL-VLV-212", "SAIL", "Valve Gate Type Cast Carbon Steel WCB 6 inch Class 150 Flanged Ends", "EA"),
    ("IOCL-VLV-312", "IOCL", 'GATE VALVE 6" 150# FLANGED RF BODY ASTM A216 WCB TRIM 13CR PER API 600', "EA"),
    ("GAIL-VLV-412", "GAIL", "Gate Valve 6IN Class 150 RF Body WCB Trim 8 to API 600", "Nos"),
    ("ONGC-VLV-113", "ONGC", "Check Valve 4IN 300# Flanged Swing Type WCB", "EA"),
    ("IOCL-VLV-313", "IOCL", 'NON RETURN VALVE SWING CHECK 4" 300# WCB FLANGED RF BS 1868', "EA"),
    ("ONGC-GSK-121", "ONGC", "Gasket Spiral Wound 4IN 150# ASME B16.20 SS316 with Graphite Filler", "EA"),
    ("SAIL-GSK-221", "SAIL", "Spiral Wound Metallic Gasket 4 inch 150 class SS 316 / Graphite filler to ASME B16.20", "EA"),
    ("IOCL-GSK-321", "IOCL", 'GASKET METALLIC SPIRAL WOUND 4" 150# WINDING SS316 GRAPHITE FILLER ASME B16.20', "PCS"),
    ("GAIL-GSK-421", "GAIL", "Gasket SW 4IN 150# SS316/Graphite with CS Outer Ring ASME B16.20", "Nos"),
    ("ONGC-GSK-122", "ONGC", "Gasket Spiral Wound 6IN 300# ASME B16.20 SS316/Graphite", "EA"),
    ("IOCL-GSK-322", "IOCL", 'GASKET SW 6" 300# RF SS316 FILLER GRAPHITE ASME B16.20', "EA"),
    ("ONGC-PIP-131", "ONGC", "Pipe Seamless Carbon Steel 4IN Sch 40 ASTM A106 Gr B", "MTR"),
    ("SAIL-PIP-231", "SAIL", "Seamless CS Pipe 4 inch Schedule 40 to ASTM A106 Grade B Beveled Ends", "MTR"),
    ("IOCL-PIP-331", "IOCL", 'PIPE SMLS CS 4" NB SCH.40 ASTM A106 GR.B BEVERAGE ENDS', "MTR"),
    ("GAIL-PIP-431", "GAIL", "Pipe CS SMLS 4IN Sch 40 ASTM A106 Gr B for Hydrocarbon Service", "MTR"),
    ("ONGC-PIP-132", "ONGC", "Pipe Seamless Stainless Steel 2IN Sch 80 ASTM A312 TP316", "MTR"),
    ("IOCL-PIP-332", "IOCL", 'PIPE SMLS SS316 2" SCH.80 ASTM A312 TP 316', "MTR"),
    ("ONGC-PMP-141", "ONGC", "Centrifugal Pump 5HP 415V 3Phase 2900 RPM for Cooling Water", "EA"),
    ("IOCL-PMP-341", "IOCL", "PUMP CENTRIFUGAL 5 HP 415 VOLT 3 PH 50 HZ FLAMEPROOF MOTOR", "Nos"),
    ("GAIL-PMP-441", "GAIL", "Centrifugal Water Pump 5HP 415V 3-Phase TEFC Motor", "EA"),
    ("ONGC-PMP-142", "ONGC", "Centrifugal Multi-Stage Pump 15HP 415V 3Phase Heavy Duty", "EA"),
    ("SAIL-PMP-242", "SAIL", "Pump Centrifugal Multistage 15 HP 415 Volt 3 Phase 50Hz for Industrial Feed", "EA"),
    ("ONGC-BRG-151", "ONGC", "Deep Groove Ball Bearing SKF 6205 2RS C3", "EA"),
    ("SAIL-BRG-251", "SAIL", "Bearing Deep Groove Ball 6205-2RS1/C3 SKF Make", "EA"),
    ("IOCL-BRG-351", "IOCL", "BALL BEARING DEEP GROOVE 6205 2RS C3 CLEARANCE FAG/SKF", "Nos"),
    ("SAIL-ELD-261", "SAIL", "Welding Electrode 3.15mm AWS E6013 for Mild Steel", "KG"),
    ("IOCL-ELD-361", "IOCL", "ELECTRODE WELDING 3.15MM X 350MM AWS A5.1 E6013", "KG"),
    ("GAIL-ELD-461", "GAIL", "Welding Electrode Dia 3.15 mm Spec AWS E6013", "KG"),
    ("SAIL-STL-271", "SAIL", "Mild Steel Plate 12mm Thick IS 2062 Grade E250", "TON"),
    ("ONGC-STL-171", "ONGC", "MS Structural Plate 12mm Thk IS 2062 Gr E250", "TON"),
]

# A match that a reviewer approved and one that the gate blocked.
DECISIONS = [
    ("TEST-HUMAN-001", "GAIL-V210", "OIL-V300", "GAIL", "OIL", "Valve Gate 300# RF ASTM A216 WCB", 0.85, "human_approved", None),
    ("TEST-BLOCKED-001", "ONGC-F001", "BPCL-F999", "ONGC", "BPCL", None, 0.97, "safety_gate_blocked", "Pressure class mismatch: 150 vs 300"),
]


def pilot_catalog(spark: SparkSession) -> DataFrame:
    """The pilot items in the catalog's form, without a category hint."""
    raw = spark.createDataFrame([(i, *row) for i, row in enumerate(PILOT, 1)], "ord long, item_id string, source_cpse string, raw_description string, unit string")
    found = specs.extract(raw.withColumn("clean_description", column(text.clean("raw_description"))), "raw_description")
    return found.select("ord", "item_id", "source_cpse", "raw_description", "clean_description", specs.nested(), column(text.unit("unit")).alias("unit_of_measure"), F.lit(None).cast("string").alias("category_hint"))


def trial_decisions(t: registry.Tables, at: datetime) -> registry.Tables:
    """The tables after the two decisions: a new code for the first, an entry without a code for the second."""
    spark = t.registry.sparkSession
    names = "ord long, match_id string, item_a string, item_b string, source_cpse_a string, source_cpse_b string, canonical_description string, confidence_score double, status string, block_reason string"
    rows = spark.createDataFrame([(i, *row) for i, row in enumerate(DECISIONS, 1)], names)
    t = registry.process(t, rows.filter("status = 'human_approved'"), "reviewer_demo", at)
    return registry.process(t, rows.filter("status = 'safety_gate_blocked'"), "system", at)


def reload(spark: SparkSession, path: str, at: datetime) -> tuple[registry.Tables, DataFrame, DataFrame]:
    """Starts over at ``path``: empty tables, the pilot catalog, its matches, and their codes; all are written there.

    Gives the tables, the catalog and the matches, as read again.
    """
    from ..plans import matching

    registry.save(registry.empty(spark), f"{path}/registry")
    pilot_catalog(spark).write.mode("overwrite").parquet(f"{path}/catalog")
    catalog = spark.read.parquet(f"{path}/catalog")
    matching.run(catalog).write.mode("overwrite").parquet(f"{path}/matches")
    matches = spark.read.parquet(f"{path}/matches")
    best_first = F.struct(-F.col("confidence_score"), "item_a", "item_b")
    ordered = registry.numbered(matches.withColumn("_o", best_first), 1, "_o").drop("_o").withColumnRenamed("number", "ord")
    tables, _ = registry.integrate(registry.empty(spark), ordered, catalog, at)
    registry.save(tables, f"{path}/registry")
    return registry.load(spark, f"{path}/registry"), catalog, matches

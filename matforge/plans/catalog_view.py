"""A material catalog derived from the driver's ``part`` table by integer arithmetic.

Each group of four parts is one item, phrased in four ways by four organisations; every third group's last phrasing
contradicts it, every fifth group's third leaves out its pressure class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import DUCK, SPARK, Dialect
from ..stages import spread

#: By kind of item: a terse and a spelled-out phrasing.
PHRASES = [
    ("VLV GATE {s}IN {m} {p}# RF", "Gate Valve {s} inch {M} Class {p} Raised Face"),
    ("BALL VLV {s}\" {m} CL.{p} NPT", "Ball Valve, {s} IN, {M}, {p} LB, Screwed End"),
    ("FLG WN RF {p}# ASTM A105 {s}IN ASME B16.5", "Weld Neck Flange Raised Face Class {p} A105 {s} inch ASME B16.5"),
    ("FLG SO FF {p}# {m} {s}IN", "Slip-On Flange, Flat Face, Class {p}, {M}, {s} inch"),
    ("GSK SW {s}IN {p}# GRAPHITE", "Spiral Wound Gasket {s} inch Class {p} Graphite filler"),
    ("PIP SMLS {s}IN SCH {h} A106 Gr B", "Seamless Pipe {s} inch Schedule {h} A106 Grade B"),
    ("PMP CENTRIFUGAL {w}HP 415V 3PH", "Centrifugal Pump {w} HP 415 Volt 3 Phase multi-stage"),
    ("MOTOR INDUCTION TEFC {w}HP {r}RPM 415V", "Induction Motor {w} HP {r} RPM 415 V 3 Phase"),
    ("BEARING DEEP GROOVE 620{b} 2RS C3", "Deep Groove Ball Bearing 620{b} 2RS C3"),
    ("WELDING ELECTRODE E6013 {e}MM", "Welding Electrode AWS E6013 {e} mm"),
]


def view_sql(d: Dialect, part: str) -> str:
    """``ord, source_cpse, material_code, description, uom`` from ``part``."""
    q = d.div("p_partkey", 4)
    pick = lambda values, by: "CASE " + " ".join(f"WHEN {by} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
    conflict = "(k = 3 AND g % 3 = 0)"
    inner = f"SELECT p_partkey AS ord, {q} AS g, p_partkey % 4 AS k, p_partkey AS code FROM {part}"
    fields = {
        "s": pick(["2", "4", "6", "8", "10"], f"(g + CASE WHEN {conflict} AND g % 2 = 0 THEN 1 ELSE 0 END) % 5"),
        "p": pick(["150", "300", "600"], f"(g + CASE WHEN {conflict} AND g % 2 = 1 THEN 1 ELSE 0 END) % 3"),
        "m": pick(["CS", "SS", "A216 WCB"], "g % 3"),
        "M": pick(["Carbon Steel", "Stainless Steel 316", "A216 WCB"], "g % 3"),
        "h": pick(["40", "80"], f"(g + CASE WHEN {conflict} THEN 1 ELSE 0 END) % 2"),
        "w": pick(["5", "7.5", "10", "15"], "g % 4"),
        "r": pick(["1440", "2900"], f"(g + CASE WHEN {conflict} THEN 1 ELSE 0 END) % 2"),
        "b": pick(["3", "4", "5"], "g % 3"),
        "e": pick(["2.5", "3.15"], "g % 2"),
    }

    def phrase(template: str) -> str:
        parts, rest = [], template
        while "{" in rest:
            before, _, after = rest.partition("{")
            parts += [f"'{before}'", f"f_{'big_m' if after[0] == 'M' else after[0]}"]
            rest = after[2:]
        return f"concat({', '.join([*parts, chr(39) + rest + chr(39)])})"

    named = ", ".join(f"{v} AS f_{'big_m' if k == 'M' else k}" for k, v in fields.items())
    terse, long = ("CASE " + " ".join(f"WHEN g % 10 = {i} THEN {phrase(p[j])}" for i, p in enumerate(PHRASES)) + " END" for j in (0, 1))
    no_class = d.replace("t", r"\b(?:class|cl\.)\s*\d+|\b\d+\s*(?:#|lb\b)", "")
    return f"""SELECT ord, {pick(['ONGC', 'SAIL', 'IOCL', 'GAIL'], 'k')} AS source_cpse, concat('MC', {d.string('code')}) AS material_code,
        CASE WHEN k = 2 AND g % 5 = 0 THEN {no_class} ELSE t END AS description, {pick(['EA', 'Nos', 'PCS', 'Each'], 'k')} AS uom, g, k
        FROM (SELECT *, CASE WHEN k % 2 = 0 THEN {terse} ELSE {long} END AS t FROM (SELECT *, {named} FROM ({inner})))"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(view_sql(SPARK, "{part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def spread_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``catalog``, written out on all cores: the keys alone are few bytes, which would be read as one task."""
    return spark.sql(view_sql(SPARK, "{part}"), part=spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), "p_partkey"))


def catalog_oracle() -> str:
    return view_sql(DUCK, "part")

"""Engineering attributes of a description, as layers of columns.

Two rule sets exist: ingestion's, and matching's for items that arrive without attributes.  They differ in patterns and in
that matching does not convert kilowatts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules, text
from .dialect import Dialect, Layers, Rule, with_layers

#: The flat attributes, in the order of the nested form.
FIELDS = (
    "category category_subtype size raw_size pressure_rating raw_pressure material_grade material_family material_base raw_material schedule power_hp voltage phase "
    "speed_rpm frequency connection_type facing standards bearing_number seal_type clearance gasket_filler"
).split()


def _first_group(x: str, pattern: tuple[str, int]) -> Rule:
    """The first group that took part in the leftmost match."""
    return lambda d: f"trim(coalesce({', '.join(d.extract(x, pattern[0], i + 1) for i in range(pattern[1]))}))"


def _tagged(x: str, pattern: str, before: str = "", after: str = "", upper: bool = False) -> Rule:
    def sql(d: Dialect) -> str:
        got = d.extract(x, pattern)
        return f"concat('{before}', {f'upper({got})' if upper else got}, '{after}')"

    return lambda d: f"CASE WHEN {d.extract(x, pattern)} IS NOT NULL THEN {sql(d)} END"


def _facing(x: str) -> Rule:
    def sql(d: Dialect) -> str:
        f = "upper(_facing)"
        return f"CASE WHEN {f} LIKE '%RF%' OR {f} LIKE '%RAISED%' THEN 'RF' WHEN {f} LIKE '%FF%' OR {f} LIKE '%FLAT%' OR {f} LIKE '%FULL%' THEN 'FF' WHEN {f} IS NOT NULL THEN 'RTJ' END"

    return sql


def layers(x: str = "description", matching: bool = False, hint: str | None = None) -> Layers:
    """Attributes of column ``x``; helper columns begin with an underscore.  ``standards`` is a text, joined by commas."""
    p, c = {**rules.COMMON_PATTERNS, **(rules.MATCH_PATTERNS if matching else rules.INGEST_PATTERNS)}, rules.COMMON_PATTERNS
    number = r"\b(\d+(?:\.\d+)?)\s*(?:HP|H\.P\.|KW)\b"
    bearing = lambda i, default: (lambda d: f"CASE WHEN category = 'BEARING' AND _bearing IS NOT NULL THEN coalesce({d.extract(x, c['bearing'], i)}, {default}) END")
    return [
        {
            "category": text.category(x, hint),
            "raw_size": _first_group(x, p["size"]),
            "raw_pressure": _first_group(x, p["pressure"]),
            "raw_material": lambda d: f"trim({d.extract(x, p['material'], 0)})",
            "_power": lambda d: d.extract(x, p["power"], 0),
            "_facing": lambda d: d.extract(x, p["facing"], 0),
            "_bearing": lambda d: d.extract(x, c["bearing"], 1),
        },
        {
            "category_subtype": text.subtype(x, "category"),
            "size": text.size("raw_size"),
            "pressure_rating": text.pressure("raw_pressure"),
            "_material": text.material("raw_material"),
            "schedule": _tagged(x, c["schedule"], "SCH_", upper=True),
            "power_hp": _tagged(x, number, after=" HP") if matching else text.power("_power"),
            "voltage": _tagged(x, c["voltage"], after="V"),
            "phase": _tagged(x, c["phase"], after="_PHASE"),
            "speed_rpm": _tagged(x, c["speed"], after="_RPM"),
            "frequency": _tagged(x, c["frequency"], after="HZ"),
            "connection_type": lambda d: f"replace(upper({d.extract(x, c['connection'], 0)}), ' ', '_')",
            "facing": _facing(x),
            "standards": lambda d: f"concat_ws(',', {', '.join(f'upper({d.extract(x, s, 0)})' for s in rules.STANDARDS)})",
            "bearing_number": bearing(1, "NULL"),
            "seal_type": bearing(2, "'OPEN'"),
            "clearance": bearing(3, "'CN'"),
            "gasket_filler": lambda d: f"CASE WHEN upper({x}) LIKE '%GRAPHITE%' THEN 'GRAPHITE' WHEN upper({x}) LIKE '%PTFE%' THEN 'PTFE' END",
        },
        {"material_grade": text.part("_material", 1), "material_family": text.part("_material", 2), "material_base": text.part("_material", 3)},
    ]


def extract(df: DataFrame, x: str = "description", matching: bool = False, hint: str | None = None) -> DataFrame:
    """``df`` with the flat attributes of column ``x``; columns of the same names are replaced."""
    df = df.drop(*(f for f in FIELDS if f in df.columns and f != x))
    out = with_layers(df, layers(x, matching, hint))
    return out.drop("_power", "_facing", "_bearing", "_material")


def nested() -> Column:
    """The nested form of the flat attributes, with ``standards`` as an array and the attributes that are kept twice."""
    standards = F.expr("filter(split(standards, ','), s -> s <> '')")
    flat = [standards.alias(f) if f == "standards" else F.col(f) for f in FIELDS]
    return F.struct(*flat, F.struct(standards.alias("standards"), F.col("facing"), F.col("schedule")).alias("other_attrs")).alias("specs")

"""The reference queries by name, over the driver's tables, and the same in plain SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, similarity, specs, text
from ..functions.dialect import DUCK, SPARK, Layers, layered_sql, with_layers
from ..operators import analytics, candidates, classes, encoder, gate, prototypes, registry
from ..sources import catalogs
from ..stages import shared_folder, small, spread, staged
from . import matching
from .catalog_view import catalog, catalog_oracle, spread_catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def layered(name: str, layers: Layers, columns: str, source: str | None = None) -> None:
    """A query that is layers over the catalog, in both dialects."""
    sql = f"SELECT {columns} FROM ({layered_sql(source or catalog_oracle(), layers, DUCK)})"
    query(name, sql)(lambda spark, d: with_layers(catalog(spark, d), layers).selectExpr(*[c.strip() for c in columns.split(",")]))


CODE = "CASE WHEN starts_with(upper(material_code), concat(source_cpse, '-')) THEN material_code ELSE concat(source_cpse, '-', material_code) END"


def _item_id(d) -> str:
    return CODE.replace("starts_with", "startswith") if d is SPARK else CODE



layered("catalog_clean", [{"clean_description": text.clean("description"), "unit_of_measure": text.unit("uom"), "item_id": _item_id, "cpse": lambda d: "upper(trim(coalesce(nullif(source_cpse, ''), 'GENERIC')))"}], "ord, item_id, cpse, clean_description, unit_of_measure")
layered("catalog_classify", [{"category": text.category("description")}, {"subtype": text.subtype("description", "category")}], "ord, category, subtype")
layered("classify_with_hint", [{"hint": lambda d: "CASE WHEN k = 0 THEN 'pump' WHEN k = 1 THEN 'nonsense' END"}, {"category": text.category("description", "hint")}], "ord, category")
_SPECS = specs.layers("description")
layered("spec_size", _SPECS, "ord, raw_size, size")
layered("spec_pressure", _SPECS, "ord, raw_pressure, pressure_rating")
layered("spec_material", _SPECS, "ord, raw_material, material_grade, material_family, material_base")
layered("spec_electrical", _SPECS, "ord, power_hp, voltage, phase, speed_rpm, frequency")
layered("spec_misc", _SPECS, "ord, schedule, connection_type, facing, standards, bearing_number, seal_type, clearance, gasket_filler")
_SPECS2 = specs.layers("description", matching=True)
layered("spec_matching_rules", _SPECS2, "ord, raw_size, size, raw_pressure, pressure_rating, material_grade, power_hp, facing")
layered("synonym_expand", [{"expanded": text.expand_synonyms("description")}], "ord, expanded")
layered("criticality_profile", [{"category": text.category("description")}, {"expected": text.expected_attributes("category"), "size_critical": text.is_critical("size", "category"), "phase_critical": text.is_critical("phase", "category")}], "ord, category, expected, size_critical, phase_critical")

#: Values written in many ways, for the canonical forms; {n} is a part's own number.
VALUES = {
    "size": ["4\"", "4 IN", "4 inch", "DN100", "100 NB", "100", "1-1/2\"", "1 1/2 inch", "0.5", "25MM", "7 NB", "4.0", "100.0", "9", "3 foot", "7.0", "{n}\"", "{n} IN", "{n} inch", "DN{n}", "{n} NB", "{n}", "{n}-1/2\"", "{n} 1/2 inch", "0.{n}", "{n}MM", "{n}.0", "{n} foot"],
    "pressure": ["CL.150", "Class 150", "150#", "150 lbs", "PN16", "PN 64", "3000 PSI", "CL 2500", "777#", "high", "150# RF", "1500", "CL.{n}00", "Class {n}50", "{n}00#", "{n}0 lbs", "PN{n}", "PN {n}", "{n}00 PSI", "CL {n}00", "{n}00# RF", "{n}00"],
    "power": ["5 HP", "5HP", "3.7 kW", "15 KILOWATT", "2.5 kW", "7.50 HP", "10 H.P.", "unknown", "110 kw", "{n} HP", "{n}HP", "{n}.7 kW", "{n} KILOWATT", "{n}.50 HP", "{n} H.P.", "{n}0 kw"],
    "material": ["A216 WCB", "WCB", "A105", "SS316", "F304", "STAINLESS STEEL", "Carbon Steel", "MS", "Inconel", "A106 Gr B", "STAINLESS_STEEL", "A182 F11", "316L", "CF8M"],
}


def _values(kind: str, d, part: str) -> str:
    """``i, v, step``: each part writes a value in the way its key picks; so all ways come with all numbers."""
    number = d.string("p_size")
    spelled = lambda v: d.text(v) if "{n}" not in v else f"concat({', '.join(x for x in (d.text(v.split('{n}')[0]), number, d.text(v.split('{n}')[1])))})"
    cases = " ".join(f"WHEN {i} THEN {spelled(v)}" for i, v in enumerate(VALUES[kind]))
    return f"SELECT p_partkey AS i, CASE p_partkey % {len(VALUES[kind])} {cases} END AS v, p_size AS step FROM {part}"


def _spelled(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return spark.sql(_values(kind, SPARK, "{part}"), part=table(spark, sf_dir, "part"))


def _canonical(kind: str, layers: Layers, columns: str) -> None:
    query(f"canonical_{kind}", f"SELECT {columns} FROM ({layered_sql(_values(kind, DUCK, 'part'), layers, DUCK)})")(lambda spark, d: with_layers(_spelled(spark, d, kind), layers).selectExpr(*columns.split(", ")))


_canonical("size", [{"canonical": text.size("v")}], "i, v, canonical")
_canonical("pressure", [{"canonical": text.pressure("v")}], "i, v, canonical")
_canonical("power", [{"canonical": text.power("v")}], "i, v, canonical")
_canonical("material", [{"m": text.material("v")}, {"grade": text.part("m", 1), "family": text.part("m", 2), "base": text.part("m", 3)}], "i, v, grade, family, base")

_MATERIAL = [{"grade": text.material_grade("v")}, {"canonical": text.material_grade("grade")}, {"family": text.material_family("canonical")}]
_PAIRED = "a.v AS a, b.v AS b"
_STATUS = text.material_status("a.canonical", "b.canonical", "a.family", "b.family")


@query("material_compat", f"WITH m AS ({layered_sql(_values('material', DUCK, 'part'), _MATERIAL, DUCK)}) SELECT a.i, {_PAIRED}, {_STATUS(DUCK)} AS status FROM m a JOIN m b ON b.i = a.i + a.step")
def material_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's material against that of the part ``p_size`` further on."""
    m = with_layers(_spelled(spark, sf_dir, "material"), _MATERIAL)
    return m.alias("a").join(m.alias("b"), F.expr("b.i = a.i + a.step")).select("a.i", F.col("a.v").alias("a"), F.col("b.v").alias("b"), F.expr(_STATUS(SPARK)).alias("status"))


@query("unit_compat", f"WITH u AS (SELECT DISTINCT uom FROM ({catalog_oracle()}) UNION SELECT 'KGS') SELECT a.uom AS a, b.uom AS b, {text.same_unit_score('a.uom', 'b.uom')(DUCK)} AS score FROM u a, u b")
def unit_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = catalog(spark, sf_dir).select("uom").union(spark.sql("SELECT 'KGS'")).distinct()  # a handful of units
    return u.alias("a").join(u.alias("b"), F.lit(True)).select(F.col("a.uom").alias("a"), F.col("b.uom").alias("b"), F.expr(text.same_unit_score("a.uom", "b.uom")(SPARK)).alias("score"))


# ---- ingestion checks

_DIRTY = """SELECT ord, CASE WHEN ord % 17 = 0 THEN '' WHEN ord % 13 = 5 THEN concat('MC', {s}) ELSE material_code END AS code,
    CASE WHEN ord % 19 = 0 THEN ' ' ELSE description END AS description, CASE WHEN ord % 23 = 0 THEN '' ELSE uom END AS uom, source_cpse FROM ({c})"""
_CHECKED = """SELECT *, CASE WHEN code <> '' AND row_number() OVER (PARTITION BY source_cpse, code ORDER BY ord) > 1 THEN 1 ELSE 0 END AS twin,
    CASE WHEN code = '' THEN 1 ELSE 0 END AS no_code, CASE WHEN trim(description) = '' THEN 1 ELSE 0 END AS no_description, CASE WHEN trim(uom) = '' THEN 1 ELSE 0 END AS no_uom FROM ({d})"""
_COUNTED = """SELECT count(*) AS total_rows, sum(CASE WHEN twin + no_code + no_description + no_uom = 0 THEN 1 ELSE 0 END) AS valid_rows,
    sum(CASE WHEN twin + no_code + no_description + no_uom > 0 THEN 1 ELSE 0 END) AS invalid_rows, sum(twin) AS duplicate_source_rows,
    sum(no_code) AS missing_material_codes, sum(no_description) AS missing_descriptions, sum(no_uom) AS missing_uom FROM ({k})"""


def _dirty(d, source: str) -> str:
    return _DIRTY.format(s=d.string("ord - ord % 4" if d is SPARK else "ord - ord % 4"), c=source)


_LONG = ", ".join(f"cast({c} AS bigint) AS {c}" for c in "total_rows valid_rows invalid_rows duplicate_source_rows missing_material_codes missing_descriptions missing_uom".split())


@query("row_validation", f"SELECT {_LONG} FROM ({_COUNTED.format(k=_CHECKED.format(d=_dirty(DUCK, catalog_oracle())))})")
def row_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of ``sources.catalogs`` over a catalog with gaps and repeats."""
    rows = spark.sql(_dirty(SPARK, "{c}").replace("({c})", "{c}"), c=catalog(spark, sf_dir))
    cells = F.create_map(*[x for h, c in (("Material Code", "code"), ("Description", "description"), ("UOM", "uom"), ("CPSE", "source_cpse")) for x in (F.lit(h), F.col(c))])
    mapping = catalogs.map_columns(["Material Code", "Description", "UOM", "CPSE"])[0]
    raw = rows.select(F.lit("view").alias("path"), F.col("ord").alias("row_idx"), cells.alias("cells"), F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]).alias("mapping"))
    n = lambda p: F.count_if(F.exists("errors", lambda e: F.startswith(e, F.lit(p))))
    return catalogs.validated(raw).agg(
        F.count("*").alias("total_rows"), F.count_if(F.size("errors") == 0).alias("valid_rows"), F.count_if(F.size("errors") > 0).alias("invalid_rows"), n("Duplicate").alias("duplicate_source_rows"),
        n("Missing material_code").alias("missing_material_codes"), n("Missing material_description").alias("missing_descriptions"), n("Missing uom").alias("missing_uom"),
    )


@query("last_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.last_by(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("catalog_append_antijoin", "SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, concat('new ', p_name) FROM part n WHERE p_partkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM part o WHERE o.p_partkey % 3 = 0 AND o.p_partkey = n.p_partkey)")
def catalog_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_partkey").alias("ord"))
    new = part.filter("p_partkey % 2 = 0").withColumn("p_name", F.concat(F.lit("new "), "p_name"))
    return analytics.append_new(part.filter("p_partkey % 3 = 0"), new, "p_partkey").select("p_partkey", "p_name")


_LOG = """SELECT ord, i, CASE i WHEN 0 THEN concat('[BLOCKED by SAFETY GATE] confidence=0.', {n}) WHEN 1 THEN concat('  A: ITEM-', {o}, ' (ONGC)') WHEN 2 THEN concat('  B: PART-', {o})
    ELSE CASE WHEN ord % 7 = 0 THEN 'noise' ELSE concat('  SAFETY GATE TRIGGERED: reason ', {n}) END END AS line FROM {c}, {lines}"""


@query(
    "log_parse",
    f"""WITH l AS (SELECT ord * 4 + i AS no, trim(line) AS t FROM ({_LOG.format(n="cast(50 + ord % 49 as varchar)", o="cast(ord as varchar)", c="(SELECT p_partkey AS ord FROM part) p", lines="(VALUES (0), (1), (2), (3)) AS x(i)")})),
    g AS (SELECT *, coalesce(sum(CASE WHEN t LIKE 'SAFETY GATE TRIGGERED:%' THEN 1 ELSE 0 END) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM l),
    r AS (SELECT n, arg_max(nullif(regexp_extract(t, 'A:\\s*([A-Z0-9-]+)', 1), ''), no) FILTER (t LIKE 'A:%') AS item_a, arg_max(nullif(regexp_extract(t, 'B:\\s*([A-Z0-9-]+)', 1), ''), no) FILTER (t LIKE 'B:%') AS item_b,
        arg_max(try_cast(regexp_extract(t, 'confidence=([0-9.]+)', 1) AS double), no) FILTER (t LIKE '[BLOCKED%') AS confidence_score, max(trim(substr(t, 23))) FILTER (t LIKE 'SAFETY GATE TRIGGERED:%') AS block_reason FROM g GROUP BY n)
    SELECT concat('BLOCKED-', item_a, '-', item_b) AS match_id, item_a, item_b, confidence_score, block_reason FROM r WHERE block_reason IS NOT NULL AND item_a IS NOT NULL AND item_b IS NOT NULL""",
)
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log of all parts; as it is one file, it is read in order by one task, line by line."""
    lines = spark.sql(_LOG.format(n="cast(50 + ord % 49 as string)", o="cast(ord as string)", c="{p}", lines="(VALUES (0), (1), (2), (3)) AS x(i)"), p=table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord")))
    return catalogs.blocked_of_log(lines.select((F.col("ord") * 4 + F.col("i")).alias("line_no"), F.col("line").alias("value"))).drop("status")


# ---- pairs: candidates, gate, similarity

_ITEM = [{"item_id": _item_id, "unit_of_measure": text.unit("uom")}]
#: Words in lower case, without repeats, for a similarity that both engines compute.
_WORDS = {SPARK: "array_distinct(filter(split(lower(description), '[^a-z0-9]+'), w -> w <> ''))", DUCK: "list_distinct(list_filter(string_split_regex(lower(description), '[^a-z0-9]+'), lambda w: w <> ''))"}
_ITEMS: Layers = [*_ITEM, *_SPECS, *gate.material_layers(), {"words": lambda d: _WORDS[d]}]
_CONDITION = "(a.category = b.category OR a.category = 'OTHER' OR b.category = 'OTHER') AND a.ord < b.ord AND a.source_cpse <> b.source_cpse"
_SIDES = [*gate.ITEM_COLUMNS, "ord", "words"]


_PAIR_COLUMNS = ", ".join(f"{s}.{c} AS {c}_{s}" for c in _SIDES for s in "ab")
_COMMON = "len(list_intersect(a.words, b.words))"
_OVERLAP_SQL = f"round_even({_COMMON} / cast(len(a.words) + len(b.words) - {_COMMON} AS double), 3)"


def _pairs_sql() -> str:
    return f"WITH i AS (SELECT * FROM ({layered_sql(catalog_oracle(), _ITEMS, DUCK)})) SELECT {_PAIR_COLUMNS}, {_OVERLAP_SQL} AS semantic FROM i a JOIN i b ON {_CONDITION}"


def with_overlap(pairs: DataFrame) -> DataFrame:
    common = "size(array_intersect(words_a, words_b))"
    return pairs.withColumn("semantic", F.expr(f"bround({common} / double(size(words_a) + size(words_b) - {common}), 3)"))


def _classed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Classes of items of one wording with all that the gate needs of them, and the items with their class."""
    items = with_layers(spread_catalog(spark, sf_dir), [{"item_id": _item_id}])
    found, members = classes.classed(items, ["source_cpse", "description", "uom"])
    return staged(with_layers(found, [{"unit_of_measure": text.unit("uom")}, *_ITEMS[1:]]).select("cls", "n", *[c for c in _SIDES if c not in ("ord", "item_id")])), members


def decided_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided pairs of classes of items, with ``pairs``: how many pairs of items each stands for.

    A decision depends on what is written of two items only, and not on which of them comes first.
    """
    found, _ = _classed(spark, sf_dir)
    scored = staged(with_overlap(classes.class_pairs(found)).withColumn("pairs", classes.number_of_pairs()))
    return gate.decide(staged(gate.evaluate(scored)))


def _decided_both_ways(found: DataFrame) -> DataFrame:
    return gate.decide(staged(gate.evaluate(staged(with_overlap(classes.both_orders(classes.class_pairs(found)))))))


_DECIDED = layered_sql(_pairs_sql(), [*gate.evaluation_layers(), *gate.decision_layers()], DUCK)


def decided_pairs(spark: SparkSession, sf_dir: str, *columns: str, where: str = "true") -> DataFrame:
    """Every pair of items that the blocking by category lets meet, with these columns of its decision."""
    found, members = _classed(spark, sf_dir)
    return classes.item_pairs(staged(members.select("ord", "item_id", "cls")), staged(_decided_both_ways(found).filter(where).select("cls_a", "cls_b", *columns)))


def spec_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs have which status by attribute.  What is unverified depends on which item comes first, so each order of two
    classes is counted."""
    found, members = _classed(spark, sf_dir)
    decided = staged(_decided_both_ways(found).select("cls_a", "cls_b", *(f"st_{n}" for n, *_ in gate.ATTRIBUTES)))
    counted = classes.decided_pairs(classes.ordered_counts(staged(members.select("ord", "cls"))), decided)
    each = F.array(*(F.struct(F.col(f"st_{n}").alias("st"), F.lit(n).alias("attribute")) for n, *_ in gate.ATTRIBUTES))
    return counted.select("pairs", F.explode(each).alias("x")).select("x.*", "pairs").filter("st is not null").groupBy("st", "attribute").agg(F.sum("pairs").alias("pairs"))


query("blocked_pairs_count", f"SELECT category_a AS category, cast(count(*) AS bigint) AS pairs FROM ({_pairs_sql()}) GROUP BY 1")(lambda spark, d: candidates.blocked_counts(with_layers(catalog(spark, d), _ITEMS).select("ord", "category", "source_cpse")))
_EVALUATED = "item_id_a, item_id_b, evaluated_specs, total_expected, matching_specs, match_ratio, coverage_ratio, technical_score, conflicts, unverified"
query("gate_eval", f"SELECT {_EVALUATED} FROM ({_DECIDED})")(lambda spark, d: decided_pairs(spark, d, *_EVALUATED.split(", ")[2:]).selectExpr(*_EVALUATED.split(", ")))
_RECORD = "item_id_a, item_id_b, semantic, unit_score, confidence_score, status, sub_classification, block_reason"
query("match_decisions", f"SELECT {_RECORD} FROM ({_DECIDED})")(lambda spark, d: decided_pairs(spark, d, *_RECORD.split(", ")[2:]).selectExpr(*_RECORD.split(", ")))
query("gate_status_counts", f"SELECT status, sub_classification, cast(count(*) AS bigint) AS pairs FROM ({_DECIDED}) GROUP BY ALL")(lambda spark, d: decided_classes(spark, d).groupBy("status", "sub_classification").agg(F.sum("pairs").alias("pairs")))
_REASONS = "SELECT st, attribute, cast(count(*) AS bigint) AS pairs FROM ({u}) WHERE st IS NOT NULL GROUP BY st, attribute"
query("spec_detail_counts", _REASONS.format(u=" UNION ALL ".join(f"SELECT st_{n} AS st, '{n}' AS attribute FROM d" for n, *_ in gate.ATTRIBUTES)).replace("SELECT st, attribute, cast", f"WITH d AS MATERIALIZED ({_DECIDED}) SELECT st, attribute, cast", 1))(spec_details)


def _detail_sql(name: str, col: str, always: bool) -> str:
    """One attribute of an explanation as text: name, both values, what became of them, how much it matters."""
    priority = f"CASE WHEN {always} OR {text.is_critical(name, 'category_a')(DUCK)} THEN 'CRITICAL' ELSE 'IMPORTANT' END"
    return f"CASE WHEN category_a = category_b AND st_{name} IS NOT NULL THEN concat_ws('/', '{name}', coalesce({col}_a, 'UNKNOWN'), coalesce({col}_b, 'UNKNOWN'), st_{name}, {priority}) END"


_RECORDS = f"""SELECT concat('M-', item_id_a, '-', item_id_b) AS match_id, item_id_a AS item_a, item_id_b AS item_b, source_cpse_a, source_cpse_b, category_a AS category, sub_classification, confidence_score, status,
    semantic AS text_similarity, technical_score AS spec_match, unit_score AS unit_compatibility, block_reason,
    CASE WHEN category_a = category_b THEN concat(category_a, ' (Matched: ', category_a, ' == ', category_b, ')') ELSE concat(category_a, ' ≠ ', category_b) END AS shown_category,
    CAST(trunc(semantic * 100) AS INTEGER) AS semantic_similarity_pct, CAST(trunc(technical_score * 100) AS INTEGER) AS technical_score_pct,
    concat(evaluated_specs, '/', total_expected, ' specs verified') AS coverage,
    CASE WHEN category_a <> category_b THEN 1 ELSE {" + ".join(f"coalesce(CAST(st_{n} = 'CONFLICT' AS INTEGER), 0)" for n, *_ in gate.ATTRIBUTES)} END AS critical_conflicts_count,
    CASE WHEN category_a = category_b THEN concat_ws('|', {", ".join(f"CASE WHEN st_{n} = 'UNVERIFIED' THEN '{n}' END" for n, *_ in gate.ATTRIBUTES)}) ELSE '' END AS unverified_critical,
    concat_ws(';', concat_ws('/', 'category', category_a, category_b, CASE WHEN category_a = category_b THEN 'MATCH' ELSE 'CONFLICT' END, 'CRITICAL'), {", ".join(_detail_sql(n, c, always) for n, c, _, always in gate.ATTRIBUTES)}) AS spec_details,
    CASE status WHEN 'safety_gate_blocked' THEN concat('Safety Gate Blocked: ', block_reason) WHEN 'auto_linked' THEN concat('Auto-Linked as ', sub_classification, ' (Confidence: ', CAST(trunc(confidence_score * 100) AS INTEGER), '%)')
        WHEN 'no_match' THEN 'No Match: Different items' ELSE concat('Routed to Human Review: ', CASE sub_classification WHEN 'NEEDS_SPEC_VALIDATION' THEN concat('Unverified critical attributes (', unverified, ')')
        WHEN 'FUNCTIONALLY_EQUIVALENT' THEN 'Functionally equivalent material family requiring engineering sign-off' ELSE 'Plausible candidate pair requiring engineer confirmation' END) END AS summary
FROM ({_DECIDED}) WHERE semantic >= {rules.PREFILTER}"""


@query("match_records", _RECORDS)
def match_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole match records, explanation included, of all blocked pairs that are not left out as too unlike."""
    found, members = _classed(spark, sf_dir)
    likely = _decided_both_ways(found).filter(F.col("semantic") >= rules.PREFILTER)
    r = gate.match_records(staged(likely.withColumns({f"item_id_{s}": F.col(f"cls_{s}") for s in "ab"})))
    e = "explanation"
    plain = [c for c in r.columns if c not in (e, "score_breakdown", "match_id", "item_a", "item_b")]
    told = [F.col(f"{e}.{c}") for c in ("semantic_similarity_pct", "technical_score_pct", "coverage", "critical_conflicts_count", "summary")]
    details = F.transform(f"{e}.spec_details", lambda d: F.concat_ws("/", *(d[c] for c in ("attribute", "val_a", "val_b", "status", "priority"))))
    records = r.select(F.col("item_a").alias("cls_a"), F.col("item_b").alias("cls_b"), *plain, "score_breakdown.*", F.col(f"{e}.category").alias("shown_category"), *told, F.array_join(f"{e}.unverified_critical", "|").alias("unverified_critical"), F.array_join(details, ";").alias("spec_details"))
    named = [_match_id(), F.col("item_id_a").alias("item_a"), F.col("item_id_b").alias("item_b")]
    return classes.item_pairs(staged(members.select("ord", "item_id", "cls")), staged(records)).select(*named, *[c for c in records.columns if c not in ("cls_a", "cls_b")])


def _match_id() -> Column:
    return F.concat(F.lit("M-"), "item_id_a", F.lit("-"), "item_id_b").alias("match_id")


@query("category_counts", f"SELECT category, cast(count(*) AS bigint) AS items FROM ({layered_sql(catalog_oracle(), [{'category': text.category('description')}], DUCK)}) GROUP BY 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_layers(catalog(spark, sf_dir), [{"category": text.category("description")}]).groupBy("category").agg(F.count("*").alias("items"))


query("cpse_counts", f"SELECT source_cpse, cast(count(*) AS bigint) AS items FROM ({catalog_oracle()}) GROUP BY 1")(lambda spark, d: analytics.by_source(catalog(spark, d)))


@query(
    "jaccard_spec",
    """WITH b AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '')) AS w FROM benchmark)
    SELECT a.item_id AS a, b.item_id AS b, CASE WHEN len(a.w) = 0 AND len(b.w) = 0 THEN 0.5 WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.3
        ELSE round(len(list_intersect(a.w, b.w)) / cast(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS double), 6) END AS score FROM b a JOIN b b ON a.item_id < b.item_id""",
)
def jaccard_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the benchmark, a table that does not grow with the corpus."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.expr("array_distinct(filter(split(lower(text), '[^a-z]+'), w -> w <> ''))").alias("w"))
    a, c = (b.select(F.col("item_id").alias(s), F.col("w").alias(f"w{s}")) for s in "ab")
    return a.join(c, F.col("a") < F.col("b")).select("a", "b", F.round(similarity.jaccard("wa", "wb"), 6).alias("score"))


_GRAM_SQL = f"""WITH w AS (SELECT item_id, ' ' || unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda t: t <> '')) || ' ' AS w FROM benchmark),
g AS (SELECT item_id, k, count(*) AS n FROM (SELECT item_id, substr(w, cast(i AS int), cast(l AS int)) AS k FROM w, (VALUES (2), (3), (4)) AS x(l), generate_series(1, 60) AS s(i)
    WHERE (length(w) >= l AND i <= length(w) - l + 1)) GROUP BY ALL),
p AS (SELECT a.item_id AS a, b.item_id AS b FROM benchmark a JOIN benchmark b ON a.item_id < b.item_id),
t AS (SELECT a, b, k, cast(sum(na) AS double) AS na, cast(sum(nb) AS double) AS nb FROM (SELECT p.a, p.b, g.k, g.n AS na, 0 AS nb FROM p JOIN g ON g.item_id = p.a UNION ALL SELECT p.a, p.b, g.k, 0, g.n FROM p JOIN g ON g.item_id = p.b) GROUP BY a, b, k)
SELECT a, b, round(sum(na * nb) / sqrt(sum(na * na * CASE WHEN nb = 0 THEN {similarity.ONE_SIDED**2} ELSE 1 END) * sum(nb * nb * CASE WHEN na = 0 THEN {similarity.ONE_SIDED**2} ELSE 1 END)), 6) AS score FROM t GROUP BY a, b"""


@query("ngram_tfidf_cosine", _GRAM_SQL)
def ngram_tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", similarity.grams("lower(text)").alias("g"))
    a, c = (b.select(F.col("item_id").alias(s), F.col("g").alias(f"g{s}")) for s in "ab")
    return a.join(c, F.col("a") < F.col("b")).select("a", "b", F.round(similarity.pair_tfidf("ga", "gb"), 6).alias("score"))


@query(
    "embedding_topk",
    """SELECT id, neighbour, round(s, 6) AS similarity, rank FROM (SELECT a.vec_id AS id, b.vec_id AS neighbour, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s,
    cast(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) DESC, b.vec_id) AS int) AS rank
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 15""",
)
def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.nearest(table(spark, sf_dir, "embeddings"), 15).select("id", "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


@query("token_ratio")
def token_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.expr(text.expand_synonyms("text")(SPARK)).alias("t"))
    a, c = (b.select(F.col("item_id").alias(s), F.col("t").alias(f"t{s}")) for s in "ab")
    return a.join(c, F.col("a") < F.col("b")).select("a", "b", F.round(similarity.token_ratio("ta", "tb"), 6).alias("score"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_layers(catalog(spark, sf_dir), _ITEM)


@query("dense_match")
def dense_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole matching plan over the catalog view."""
    return matching.run(_items(spark, sf_dir).select("ord", "item_id", "source_cpse", "description", "uom")).drop("explanation", "score_breakdown")


def _prototype_sql(items: str, least: float, columns: str) -> str:
    """The older scorer over ``ord, item_id, source_cpse, description, unit, n``, all pairs compared, written out in plain SQL.

    The longest common subsequence is computed row by row of its table, for the pairs that can still reach ``least``.
    """
    found = lambda g, p=rules.PROTOTYPE_PRESSURE: f"nullif(regexp_extract(description, '(?i){p}', {g}), '')"
    listed = ", ".join(f"regexp_extract_all(description, '(?i){p}', {g})" for p, g in prototypes.TOKENS_A)
    units = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.PROTOTYPE_UNITS.items())
    reason = " ".join(f"WHEN a.{c} <> b.{c} THEN concat('{c} differs: ', a.{c}, ' vs ', b.{c})" for c in ("pressure_class", "material_grade"))
    return f"""WITH RECURSIVE items AS MATERIALIZED (
    SELECT *, array_to_string(list_sort(list_filter(string_split_regex(description, '\\s+'), lambda t: t <> '')), ' ') AS sorted, CASE unit {units} END AS same_unit,
        list_distinct(list_transform(flatten([{listed}]), lambda t: lower(regexp_replace(t, '\\s+', '', 'g')))) AS tokens, upper(coalesce({found(1)}, {found(2)})) AS pressure_class, upper(trim({found(1, rules.PROTOTYPE_GRADE)})) AS material_grade
    FROM ({items})
), words AS (SELECT ord, n, ' ' || unnest(list_filter(string_split_regex(lower(description), '\\s+'), lambda t: t <> '')) || ' ' AS w FROM items
), grams AS (SELECT ord, n, k, count(*) AS c FROM (SELECT ord, n, unnest(list_transform(range(1, length(w) - l + 2), lambda i: substr(w, CAST(i AS INT), CAST(l AS INT)))) AS k FROM words, (VALUES (2), (3), (4)) AS x(l) WHERE length(w) >= l) GROUP BY ALL
), rare AS (SELECT k, ln((1.0 + (SELECT sum(n) FROM items)) / (1.0 + sum(n))) + 1 AS idf FROM grams GROUP BY k
), raw AS (SELECT ord, k, c * idf AS w FROM grams JOIN rare USING (k)
), vec AS MATERIALIZED (SELECT ord, k, w / sqrt(sum(w * w) OVER (PARTITION BY ord)) AS w FROM raw
), dots AS (SELECT x.ord AS a, y.ord AS b, sum(x.w * y.w) AS cosine FROM vec x JOIN vec y ON x.k = y.k AND x.ord < y.ord GROUP BY ALL
), p AS MATERIALIZED (
    SELECT a.ord AS a, b.ord AS b, a.sorted AS sa, b.sorted AS sb, coalesce(cosine, 0) AS cosine, CASE WHEN a.same_unit IS NOT DISTINCT FROM b.same_unit THEN 1.0 ELSE 0.4 END AS unit_score, CASE {reason} ELSE '' END AS block_reason,
        CASE WHEN len(a.tokens) = 0 AND len(b.tokens) = 0 THEN 0.5 WHEN len(a.tokens) = 0 OR len(b.tokens) = 0 THEN 0.3 ELSE len(list_intersect(a.tokens, b.tokens)) / CAST(len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens)) AS DOUBLE) END AS spec_score
    FROM items a JOIN items b ON a.ord < b.ord AND a.source_cpse <> b.source_cpse LEFT JOIN dots d ON d.a = a.ord AND d.b = b.ord
    WHERE 0.35 * coalesce(cosine, 0) + 0.65 >= {least} - 0.001
), texts AS MATERIALIZED (SELECT DISTINCT sa, sb, row_number() OVER (ORDER BY sa, sb) AS t FROM (SELECT DISTINCT sa, sb FROM p)
), cells AS (
    SELECT t, 0 AS i, unnest(range(1, length(sa) + 1)) AS j, 0 AS v FROM texts
    UNION ALL SELECT t, i, j, CAST(max(c) OVER (PARTITION BY t ORDER BY j) AS INTEGER) FROM (
        SELECT r.t, r.i + 1 AS i, j, greatest(v, CASE WHEN substr(sa, CAST(j AS INT), 1) = substr(sb, r.i + 1, 1) THEN coalesce(lag(v) OVER (PARTITION BY r.t ORDER BY j), 0) + 1 ELSE 0 END) AS c
        FROM cells r JOIN texts ON texts.t = r.t WHERE r.i < length(sb))
), ratios AS (SELECT sa, sb, CASE WHEN length(sa) + length(sb) = 0 THEN 1.0 ELSE 2.0 * coalesce(max(v), 0) / (length(sa) + length(sb)) END AS ratio FROM texts LEFT JOIN cells USING (t) GROUP BY sa, sb
), s AS (SELECT p.*, 0.7 * cosine + 0.3 * ratio AS text_score FROM p JOIN ratios USING (sa, sb)
), c AS (SELECT *, round_even(0.5 * text_score + 0.3 * spec_score + 0.2 * unit_score, 3) AS confidence FROM s)
SELECT {columns} FROM (
    SELECT x.item_id AS item_a, y.item_id AS item_b, x.n AS n_a, y.n AS n_b, round_even(text_score, 3) AS text_score, CAST(spec_score AS DOUBLE) AS spec_score, CAST(unit_score AS DOUBLE) AS unit_score, confidence,
        CASE WHEN block_reason <> '' THEN 'safety_gate_blocked' WHEN confidence >= {rules.AUTO_LINK} THEN 'auto_linked' ELSE 'needs_review' END AS status, block_reason
    FROM c JOIN items x ON x.ord = c.a JOIN items y ON y.ord = c.b WHERE confidence >= {least})"""


_SCORED = "item_a, item_b, text_score, spec_score, unit_score, confidence, status, block_reason"


@query("encoder_recall")
def encoder_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``encoder, pairs, found, found_3``: pairs of one catalog item in two phrasings, and those of them among the 15 and the 3
    nearest neighbours, with hashed counts and with vectors learned from the whole catalog.

    Items of one description are one vector, as their neighbours would be nothing but each other.
    """
    items = spread_catalog(spark, sf_dir).select("ord", "g", "k", "description").filter("not (k = 3 and g % 3 = 0)")  # that phrasing contradicts its item
    ids = staged(items.groupBy("description").agg(F.min("ord").alias("id")))
    named = items.join(small(ids), "description").select("g", "id").distinct()
    known = named.alias("x").join(named.alias("y"), "g").filter("x.id < y.id").select(F.col("x.id").alias("id"), F.col("y.id").alias("neighbour")).distinct()
    out = None
    for name, model in (("hashed", similarity.hashed_encoder), ("learned", encoder.learn(items, "description"))):
        near = candidates.nearest(ids.select("id", similarity.encode("description", model).alias("v")), 15, "id", "v").select("id", "neighbour", "rank")
        either = near.union(near.select("neighbour", "id", "rank")).groupBy("id", "neighbour").agg(F.min("rank").alias("rank"))
        one = known.join(either, ["id", "neighbour"], "left").agg(F.count("*").alias("pairs"), F.count("rank").alias("found"), F.count_if(F.col("rank") <= 3).alias("found_3")).select(F.lit(name).alias("encoder"), "pairs", "found", "found_3")
        out = one if out is None else out.unionByName(one)
    return out


@query("prototype_scores", _prototype_sql("SELECT item_id AS ord, CAST(item_id AS VARCHAR) AS item_id, CASE WHEN item_id % 2 = 0 THEN 'ONGC' ELSE 'IOCL' END AS source_cpse, text AS description, 'EA' AS unit, 1 AS n FROM benchmark", -1, _SCORED))
def prototype_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older scorer over the benchmark texts as descriptions of two sources (it compares all pairs)."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.col("item_id").cast("string").alias("item_id"), F.expr("CASE WHEN item_id % 2 = 0 THEN 'ONGC' ELSE 'IOCL' END").alias("source_cpse"), F.col("text").alias("description"), F.lit("EA").alias("unit"))
    return prototypes.score(b)


_CLASSES = f"SELECT min(ord) AS ord, arg_min(item_id, ord) AS item_id, source_cpse, description, unit, count(*) AS n FROM (SELECT *, {CODE} AS item_id, uom AS unit FROM ({catalog_oracle()})) GROUP BY source_cpse, description, unit"


@query("prototype_links", _prototype_sql(_CLASSES, rules.AUTO_LINK, _SCORED.replace("item_b,", "item_b, n_a, n_b,")))
def prototype_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the older scorer links or blocks at its threshold in the whole catalog: pairs of classes of equal items, by their
    first ones, and how many items each stands for."""
    return prototypes.score(spread(staged(prototypes.classes(with_layers(spread_catalog(spark, sf_dir), _ITEM).withColumn("unit", F.col("uom")))), "ord"), least=rules.AUTO_LINK)


# ---- registry and exports

@query("mint_codes")
def mint_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and mappings of all pairs that the whole matching plan links, folded best first (ties: by item)."""
    found = staged(matching.run(_items(spark, sf_dir).select("ord", "item_id", "source_cpse", "description", "uom"))).filter("status = 'auto_linked'")
    best_first = registry.numbered(found.withColumn("_o", F.struct(-F.col("confidence_score"), "item_a", "item_b")), 1, "_o")
    linked = best_first.select(F.col("number").alias("ord"), "match_id", "item_a", "item_b", "source_cpse_a", "source_cpse_b", F.col("item_a").alias("canonical_description"), "confidence_score")
    t = registry.mint(registry.empty(spark), linked, "auto_linked", "tier2_system", _dt())
    return t.mapping.select("cnmc_code", "source_cpse", "original_code")


_SESSIONS = f"""WITH c AS (SELECT g, k, source_cpse, {CODE} AS code FROM ({catalog_oracle()})),
one AS (SELECT g, row_number() OVER (ORDER BY g) AS n FROM (SELECT g FROM c WHERE k IN (0, 1) GROUP BY g HAVING count(*) = 2)),
two AS (SELECT g, (SELECT count(*) FROM one) + row_number() OVER (ORDER BY g) AS n FROM (SELECT g FROM c WHERE k IN (1, 2) GROUP BY g HAVING count(*) = 2) WHERE g NOT IN (SELECT g FROM one))
SELECT printf('CNMC-%06d', n) AS cnmc_code, source_cpse, code AS original_code FROM c JOIN one USING (g) WHERE k IN (0, 1) OR k = 2
UNION ALL SELECT printf('CNMC-%06d', n), source_cpse, code FROM c JOIN two USING (g) WHERE k IN (1, 2)"""


@query("registry_sessions", _SESSIONS)
def registry_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored registry in two sessions over the whole catalog: the first mints a code for the first two phrasings of each item, the
    second loads what was stored, adds the third phrasing, and stores all tables as the next version."""
    items = staged(_items(spark, sf_dir).select("g", "k", "source_cpse", "item_id"))

    def linked(one: int, other: int) -> DataFrame:
        a, b = (items.filter(F.col("k") == k).select("g", F.col("item_id").alias(f"item_{s}"), F.col("source_cpse").alias(f"source_cpse_{s}")) for k, s in ((one, "a"), (other, "b")))
        both = a.join(b, "g").withColumnRenamed("g", "ord")
        return both.withColumns({"match_id": F.concat_ws("-", F.lit("M"), "item_a", "item_b"), "canonical_description": F.col("item_a"), "confidence_score": F.lit(0.9)})

    path = shared_folder(spark, "registry")
    for pair in ((0, 1), (1, 2)):
        registry.transact(spark, path, lambda t, pair=pair: registry.mint(t, linked(*pair), "auto_linked", "tier2_system", _dt()))
    return registry.load(spark, path).mapping.select("cnmc_code", "source_cpse", "original_code")


def _dt():
    from datetime import datetime

    return datetime(2024, 1, 1)


@query("next_code", "SELECT printf('CNMC-%06d', max(p_partkey) + 1) AS code FROM part")
def next_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "part").select(registry.code_of(F.col("p_partkey")).alias("cnmc_code"))
    return spark.range(1).select(registry.code_of(F.lit(registry.next_number(codes))).alias("code"))


_REGISTRY = "SELECT printf('CNMC-%06d', s_suppkey) AS cnmc_code, s_name AS canonical_description, s_nationkey FROM supplier"


def _shape(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A registry and mappings of the driver's tables: suppliers are codes, parts are mapped to them by number."""
    s = table(spark, sf_dir, "supplier")
    reg = s.select(registry.code_of(F.col("s_suppkey")).alias("cnmc_code"), F.col("s_name").alias("canonical_description"), (F.col("s_acctbal") / 10000).alias("confidence_at_merge"), F.lit("auto_linked").alias("merge_type"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(s_suppkey % 28 as int))").alias("created_at"))
    n = s.agg(F.max("s_suppkey")).first()[0] or 1
    m = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), registry.code_of(F.col("p_partkey") % (n + 1)).alias("cnmc_code"), F.col("p_brand").alias("source_cpse"), F.concat(F.lit("MC"), "p_partkey").alias("original_code"))
    return reg, m


_M = "(SELECT p_partkey AS id, printf('CNMC-%06d', p_partkey % (SELECT max(s_suppkey) + 1 FROM supplier)) AS cnmc_code, p_brand AS source_cpse, concat('MC', p_partkey) AS original_code FROM part)"


@query("registry_exists_filter", f"SELECT cnmc_code, canonical_description FROM ({_REGISTRY}) r WHERE EXISTS (SELECT 1 FROM {_M} m WHERE m.cnmc_code = r.cnmc_code AND m.source_cpse = (SELECT min(p_brand) FROM part))")
def registry_exists_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg, m = _shape(spark, sf_dir)
    brand = table(spark, sf_dir, "part").agg(F.min("p_brand")).first()[0]
    return analytics.filter_registry(reg, m, brand).select("cnmc_code", "canonical_description")


@query("registry_nested", f"SELECT r.cnmc_code, coalesce(string_agg(concat(m.source_cpse, ':', m.original_code), ';' ORDER BY m.id), '') AS mappings FROM ({_REGISTRY}) r LEFT JOIN {_M} m ON m.cnmc_code = r.cnmc_code GROUP BY 1")
def registry_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = analytics.with_mappings(*_shape(spark, sf_dir))
    return full.select("cnmc_code", F.array_join(F.transform("mappings", lambda x: F.concat(x["source_cpse"], F.lit(":"), x["original_code"])), ";").alias("mappings"))


@query("registry_search", f"SELECT r.cnmc_code, coalesce((SELECT string_agg(DISTINCT source_cpse, ',' ORDER BY source_cpse) FROM {_M} m WHERE m.cnmc_code = r.cnmc_code), '') AS sources FROM ({_REGISTRY}) r WHERE canonical_description ILIKE '%1_3%' OR r.cnmc_code ILIKE '%1_3%' OR EXISTS (SELECT 1 FROM {_M} m WHERE m.cnmc_code = r.cnmc_code AND original_code ILIKE '%1_3%')")
def registry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg, m = _shape(spark, sf_dir)
    items = _items(spark, sf_dir).withColumn("clean_description", F.col("description"))
    return analytics.search(reg, m, items, "1_3", (analytics.registry_index(reg, m), None))[0].select("cnmc_code", F.coalesce(F.array_join("sources", ","), F.lit("")).alias("sources"))


@query("catalog_search", f"SELECT ord, item_id FROM (SELECT *, {CODE} AS item_id FROM ({catalog_oracle()})) WHERE contains(lower(description), 'gate valve') OR contains(lower(item_id), 'gate valve') ORDER BY ord LIMIT 10")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten hits: the limit is the feature."""
    reg, m = _shape(spark, sf_dir)
    items = with_layers(spread_catalog(spark, sf_dir), _ITEM).withColumn("clean_description", F.col("description"))
    return analytics.search(reg, m, items, "Gate Valve", (None, analytics.catalog_index(items)))[1].select("ord", "item_id")


@query("catalog_filter", f"SELECT ord FROM ({catalog_oracle()}) WHERE source_cpse = 'SAIL' AND contains(lower(description), 'pump')")
def catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = with_layers(spread_catalog(spark, sf_dir), _ITEM).withColumns({"clean_description": F.col("description"), "raw_description": F.col("description")})
    return analytics.filter_catalog(items, "sail", "Pump", analytics.catalog_index(items)).select("ord")


_DEC = "(SELECT *, concat('M-', item_id_a, '-', item_id_b) AS match_id FROM d)"
_PENDING = f"""WITH d AS MATERIALIZED ({_DECIDED}), m AS (SELECT * FROM {_DEC} WHERE status <> 'no_match'),
map AS (SELECT {CODE} AS code, printf('CNMC-%06d', g) AS cnmc FROM ({catalog_oracle()}) WHERE g % 3 = 0 AND k < 2)
SELECT match_id, CASE WHEN ord_a % 11 = 0 THEN 'human_rejected' WHEN ord_a % 13 = 0 THEN 'human_approved' WHEN x.cnmc = y.cnmc THEN 'human_approved' ELSE status END AS status, coalesce(x.cnmc, y.cnmc) AS cnmc_code
FROM m LEFT JOIN map x ON x.code = item_id_a LEFT JOIN map y ON y.code = item_id_b"""


def _queue(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    """The queue's statuses and codes.  Each item has its codes before pairs are written out: a lookup for each match would deal
    all of them by item, twice."""
    found, members = _classed(spark, sf_dir)
    mapping = members.filter("g % 3 = 0 and k < 2").select(F.col("ord").alias("id"), registry.code_of(F.col("g")).alias("cnmc_code"), "source_cpse", F.col("item_id").alias("original_code"))
    codes = small(staged(registry.codes_of(mapping).withColumnRenamed("original_code", "item_id")))
    coded = staged(members.select("ord", "item_id", "cls").join(codes, "item_id", "left"))
    pairs = classes.item_pairs(coded, staged(_decided_both_ways(found).filter("status <> 'no_match'").select("cls_a", "cls_b", "status")))
    first = F.col("ord_a")
    # who decided follows from the first item, so each match carries it: a billion matches and decisions would be dealt by id else
    decided = F.when(first % 11 == 0, "rejected").when(first % 13 == 0, "approved").alias("decided")
    return registry.shown(pairs.select(_match_id(), F.col("item_id_a").alias("item_a"), F.col("item_id_b").alias("item_b"), "status", "codes_a", "codes_b", decided), status)


query("pending_queue", _PENDING)(lambda spark, d: _queue(spark, d).select("match_id", "status", "cnmc_code"))
query("pending_blocked", f"SELECT * FROM ({_PENDING}) WHERE status = 'safety_gate_blocked'")(lambda spark, d: _queue(spark, d, "safety_blocked").select("match_id", "status", "cnmc_code"))


@query(
    "stats_savings",
    f"""WITH d AS (SELECT status FROM ({_DECIDED})), s AS (SELECT cast(count(*) AS bigint) AS total, cast(count(*) FILTER (status = 'auto_linked') AS bigint) AS auto_linked, cast(count(*) FILTER (status = 'needs_review') AS bigint) AS needs_review,
    cast(count(*) FILTER (status = 'safety_gate_blocked') AS bigint) AS safety_gate_blocked FROM d), n AS (SELECT cast(count(*) AS bigint) AS items, (SELECT count(*) FROM supplier) AS codes FROM part)
    SELECT total, auto_linked, needs_review, safety_gate_blocked, items, codes, round_even(codes / greatest(items, 1) * 100, 1) AS duplicate_percent,
    round_even(500.0 * CASE WHEN round_even(codes / greatest(items, 1) * 100, 1) = 0 THEN 25.0 ELSE round_even(codes / greatest(items, 1) * 100, 1) END / 100 * 0.12, 2) AS savings FROM s, n""",
)
def stats_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg, m = _shape(spark, sf_dir)
    audit = registry.empty(spark).audit
    return analytics.stats(catalog(spark, sf_dir), decided_classes(spark, sf_dir), reg, m, audit, weight="pairs").drop("mappings", "audits", "human_approved")


_EXPORT_SQL = f"""SELECT r.canonical_description AS "STANDARDIZED_DESCRIPTION", printf('%.2f', s_acctbal / 10000) AS "CONFIDENCE_SCORE", 'auto_linked' AS "MERGE_TYPE", 'READY_FOR_SAP_ERP_IMPORT' AS "MAPPING_STATUS",
strftime(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(s_suppkey % 28 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS "EXPORT_TIMESTAMP", r.cnmc_code AS "CNMC_RECOMMENDED_CODE", i.source_cpse AS "SOURCE_CPSE", i.item_id AS "LEGACY_MATERIAL_CODE", i.description AS "ORIGINAL_DESCRIPTION", i.unit_of_measure AS "UOM", i.category AS "CATEGORY",
coalesce(nullif(concat_ws('; ', 'Size: ' || i.size, 'Rating: ' || i.pressure_rating, 'Material: ' || coalesce(i.material_grade, i.material_family), 'Facing: ' || i.facing, 'Sch: ' || i.schedule, 'Power: ' || i.power_hp, 'Speed: ' || i.speed_rpm), ''), 'N/A') AS "KEY_SPECIFICATIONS"
FROM ({_REGISTRY.replace("s_nationkey", "s_nationkey, s_acctbal, s_suppkey")}) r JOIN ({layered_sql(catalog_oracle(), [*_ITEM, *_SPECS], DUCK)}) i ON printf('CNMC-%06d', i.g) = r.cnmc_code"""


@query("sap_export", _EXPORT_SQL)
def sap_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg, _ = _shape(spark, sf_dir)
    found, members = classes.classed(with_layers(spread_catalog(spark, sf_dir), _ITEM), ["description"])
    items = members.drop("description").join(small(staged(specs.extract(found, "description"))), "cls")
    full = items.select("*", specs.nested()).withColumns({"raw_description": F.col("description"), "clean_description": F.col("description"), "category_hint": F.col("category")})
    mapping = items.select(F.col("ord").alias("id"), registry.code_of(F.col("g")).alias("cnmc_code"), "source_cpse", F.col("item_id").alias("original_code"))
    return analytics.sap_export(reg, mapping, full)


@query("audit_export", """SELECT event_id AS "ENTRY_ID", event_type AS "ACTION", CASE WHEN user_id % 2 = 0 THEN 'N/A' ELSE concat('CNMC-', user_id) END AS "CNMC_CODE", coalesce(json_extract_string(props, '$.k'), '') AS "MATCH_ID",
strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "TIMESTAMP", 'x' AS "ACTOR", '' AS "ITEM_A", '' AS "ITEM_B", '' AS "CONFIDENCE_SCORE", '' AS "REASON_OR_NOTES" FROM events""")
def audit_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    details = F.regexp_replace("props", '"k"', '"match_id"')
    audit = e.select(F.col("event_id").alias("entry_id"), F.when(F.col("user_id") % 2 != 0, F.concat(F.lit("CNMC-"), "user_id")).alias("cnmc_code"), F.col("event_type").alias("action"), F.lit("x").alias("actor"), details.alias("details"), F.col("ts").cast("timestamp_ntz").alias("timestamp"))
    return analytics.audit_export(audit)


query("audit_filter", "SELECT event_id, event_type FROM events WHERE event_type = 'error'")(
    lambda spark, d: analytics.filter_audit(table(spark, d, "events").select("event_id", "event_type", F.col("event_type").alias("action"), F.col("ts").alias("timestamp"), F.col("event_id").alias("entry_id")), "error").select("event_id", "event_type")
)
query("registry_update", "SELECT s_suppkey, CASE WHEN s_suppkey = 1 THEN 'fixed' ELSE s_name END AS canonical_description FROM supplier")(
    lambda spark, d: registry.update_description(table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("cnmc_code"), F.col("s_name").alias("canonical_description")), "1", "fixed").drop("cnmc_code")
)


_HALVES_SQL = f"""WITH i AS (SELECT * FROM ({layered_sql(catalog_oracle(), _ITEMS, DUCK)})) SELECT {_PAIR_COLUMNS}, {_OVERLAP_SQL} AS semantic, a.g * 2 + a.k // 2 AS ord
FROM i a JOIN i b ON a.g = b.g AND a.k IN (0, 2) AND b.k = a.k + 1"""
_HALVES = layered_sql(_HALVES_SQL, [*gate.evaluation_layers(), *gate.decision_layers()], DUCK)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Decided matches between the first two and between the last two phrasings of each item, in an order; and their items."""
    found, members = _classed(spark, sf_dir)
    items = staged(members.select("ord", "item_id", "source_cpse", "cls", "g", F.expr("k div 2").alias("half"), F.expr("k % 2").alias("side"), F.col("description").alias("clean_description")))
    a, b = (items.filter(F.col("side") == i).select("g", "half", *(F.col(c).alias(f"{c}_{s}") for c in ("item_id", "source_cpse", "cls"))) for i, s in enumerate("ab"))
    met = staged(a.join(b, ["g", "half"]))
    # decided once for each two classes that meet
    kinds = met.select("cls_a", "cls_b").distinct()
    for s in "ab":
        kinds = kinds.join(small(found.select(*(F.col(c).alias(f"{c}_{s}") for c in found.columns))), f"cls_{s}")
    told = gate.decide(staged(gate.evaluate(staged(with_overlap(kinds))))).select("cls_a", "cls_b", "confidence_score", "status", "block_reason")
    decided = met.join(small(staged(told)), ["cls_a", "cls_b"])
    matches = decided.select((F.col("g") * 2 + F.col("half")).alias("ord"), F.concat(F.lit("M-"), "item_id_a", F.lit("-"), "item_id_b").alias("match_id"), F.col("item_id_a").alias("item_a"), F.col("item_id_b").alias("item_b"), "source_cpse_a", "source_cpse_b", "confidence_score", "status", "block_reason")
    return staged(matches), items


_REVIEW = f"""WITH m AS MATERIALIZED (SELECT ord, concat('M-', item_id_a, '-', item_id_b) AS match_id, status FROM ({_HALVES})),
d AS (SELECT ord, status, CASE WHEN ord % 7 = 4 THEN concat('no ', match_id) ELSE match_id END AS match_id, CASE ord % 7 WHEN 1 THEN 'rejected' WHEN 3 THEN 'maybe' WHEN 5 THEN NULL WHEN 2 THEN ' Approved ' ELSE 'approved' END AS decision FROM m WHERE ord % 7 < 6),
j AS (SELECT *, lower(trim(decision)) AS verdict, CASE WHEN ord % 7 IN (3, 5) THEN 'a decision is approved or rejected' WHEN ord % 7 = 4 THEN 'match is not known'
    WHEN status = 'safety_gate_blocked' AND ord % 7 <> 1 THEN 'a blocked match cannot be approved' END AS reason FROM d),
coded AS (SELECT ord, printf('CNMC-%06d', row_number() OVER (ORDER BY ord)) AS cnmc_code FROM j WHERE reason IS NULL AND verdict = 'approved')
SELECT CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY reason IS NULL ORDER BY ord) ELSE 0 END AS entry_id, match_id, CASE WHEN reason IS NULL THEN 'human_' || verdict ELSE 'refused' END AS action, 'r' || (ord % 3) AS actor,
    strftime(TIMESTAMP '2024-01-01' + to_seconds(ord), '%Y-%m-%dT%H:%M:%S') AS at, cnmc_code, coalesce(reason, CASE WHEN verdict = 'rejected' THEN 'not the same' END) AS reason FROM j LEFT JOIN coded USING (ord)"""


@query("review_decisions", _REVIEW)
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of reviewers' decisions, good and bad ones, on matches of the whole catalog: what was recorded and what was refused."""
    matches, items = _halves(spark, sf_dir)
    kind = F.col("ord") % 7
    asked = matches.filter(kind < 6).select(
        F.when(kind == 4, F.concat(F.lit("no "), "match_id")).otherwise(F.col("match_id")).alias("match_id"),
        F.when(kind == 1, "rejected").when(kind == 2, " Approved ").when(kind == 3, "maybe").when(kind != 5, "approved").alias("decision"),
        F.concat(F.lit("r"), F.col("ord") % 3).alias("reviewer_id"),
        F.timestamp_seconds(F.col("ord") + 1704067200).alias("reviewed_at"),
        F.when(kind == 1, "not the same").alias("notes"),
    )
    t, refused = registry.decide_all(registry.empty(spark), matches, items, asked, _dt())
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias("at")
    done = t.audit.select("entry_id", F.get_json_object("details", "$.match_id").alias("match_id"), "action", "actor", at("timestamp"), "cnmc_code", F.get_json_object("details", "$.reason").alias("reason"))
    return done.unionByName(refused.select(F.lit(0).cast("long").alias("entry_id"), "match_id", F.lit("refused").alias("action"), F.col("reviewer_id").alias("actor"), at("reviewed_at"), F.lit(None).cast("string").alias("cnmc_code"), "reason"))


_BATCH = f"""WITH m AS (SELECT *, row_number() OVER (ORDER BY ord) AS n FROM (SELECT * FROM ({_HALVES}) WHERE confidence_score >= 0.7 AND status <> 'safety_gate_blocked' AND ord % 7 <> 1)),
sides AS (SELECT 2 * n - 1 AS id, n, source_cpse_a AS source_cpse, item_id_a AS original_code, * FROM m UNION ALL SELECT 2 * n, n, source_cpse_b, item_id_b, * FROM m)
SELECT id, printf('CNMC-%06d', sides.n) AS cnmc_code, source_cpse, original_code, confidence_score AS confidence_at_merge, 'human_approved' AS merge_type, c.description AS canonical_description
FROM sides JOIN (SELECT description, {CODE} AS item_id FROM ({catalog_oracle()})) c ON c.item_id = item_id_a"""


@query("batch_approval", _BATCH)
def batch_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and mappings after a batch approval of matches of the whole catalog, some of which were rejected before."""
    matches, items = _halves(spark, sf_dir)
    rejected = matches.filter(F.col("ord") % 7 == 1).select("match_id", F.lit("rejected").alias("decision"), F.lit("r").alias("reviewer_id"), F.lit(None).cast("timestamp").alias("reviewed_at"), F.lit(None).cast("string").alias("notes"))
    t, _ = registry.decide_all(registry.empty(spark), matches, items, rejected, _dt())
    t = registry.batch_approve(t, matches, items, _dt())
    return t.mapping.join(t.registry, "cnmc_code").select("id", "cnmc_code", "source_cpse", "original_code", "confidence_at_merge", "merge_type", "canonical_description")


_FROM, _TO = "2024-01-05 00:00:00", "2024-01-20 00:00:00"


@query("registry_window", f"SELECT r.cnmc_code, r.created_at, count(m.id) AS mappings FROM (SELECT printf('CNMC-%06d', s_suppkey) AS cnmc_code, TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 28 AS INTEGER)) AS created_at FROM supplier) r LEFT JOIN {_M} m USING (cnmc_code) WHERE r.created_at >= TIMESTAMP '{_FROM}' AND r.created_at <= TIMESTAMP '{_TO}' GROUP BY ALL")
def registry_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes created within two times, both included."""
    from datetime import datetime

    found = analytics.filter_registry(*_shape(spark, sf_dir), start=datetime.fromisoformat(_FROM), end=datetime.fromisoformat(_TO))
    return found.select("cnmc_code", "created_at", F.size("mappings").cast("long").alias("mappings"))


@query("overview", f"""WITH d AS (SELECT status FROM ({_DECIDED})) SELECT (SELECT count(*) FROM d) AS total, count(*) FILTER (status = 'auto_linked') AS auto_linked, count(*) FILTER (status = 'needs_review') AS needs_review,
count(*) FILTER (status = 'safety_gate_blocked') AS safety_gate_blocked, (SELECT count(*) FROM part) AS items, (SELECT count(*) FROM supplier) AS codes, (SELECT count(*) FROM part) AS mappings,
(SELECT count(*) FROM events) AS audits, (SELECT count(*) FROM events WHERE user_id % 4 = 0) AS human_approved FROM d""")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts of the overview: the audit trail is the table of events."""
    audit = table(spark, sf_dir, "events").select(F.expr("CASE WHEN user_id % 4 = 0 THEN 'human_approved' ELSE 'auto_linked' END").alias("action"))
    return analytics.stats(catalog(spark, sf_dir), decided_classes(spark, sf_dir), *_shape(spark, sf_dir), audit, weight="pairs").drop("duplicate_percent", "savings")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog to decisions: cleaning, attributes, blocked pairs, gate, counts by decision."""
    return QUERIES["gate_status_counts"](spark, sf_dir)


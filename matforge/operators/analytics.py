"""Counts, savings, search and exports over catalog, matches and registry."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import postings

UNIT_SPEND, SAVED = 500.0, 0.12  # assumed spend by item and share saved


def by_source(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy(F.coalesce("source_cpse", F.lit("UNKNOWN")).alias("source_cpse")).agg(F.count("*").alias("items"))


def by_status(matches: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: matches in each state; those that are no match are not counted.  A row stands for ``weight`` matches."""
    n = F.col(weight) if weight else F.lit(1)
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    states = ("auto_linked", "needs_review", "safety_gate_blocked")
    return matches.agg(count(n).alias("total"), *(count(F.when(F.col("status") == s, n)).alias(s) for s in states))


def savings(items: Column, codes: Column) -> tuple[Column, Column]:
    """Share of duplicates in percent, and savings (a share of 25 is assumed where there are none)."""
    share = F.bround(codes / F.greatest(items, F.lit(1)) * 100, 1)
    return share, F.bround(F.lit(UNIT_SPEND) * F.when(share == 0, 25.0).otherwise(share) / 100 * SAVED, 2)


def stats(catalog: DataFrame, matches: DataFrame, registry: DataFrame, mapping: DataFrame, audit: DataFrame, weight: str | None = None) -> DataFrame:
    """One row with all counts of the overview; a row of ``matches`` stands for ``weight`` of them."""
    one = (
        by_status(matches, weight)
        .join(catalog.agg(F.count("*").alias("items")), how="cross")
        .join(registry.agg(F.count("*").alias("codes")), how="cross")
        .join(mapping.agg(F.count("*").alias("mappings")), how="cross")
        .join(audit.agg(F.count("*").alias("audits"), F.count_if(F.col("action") == "human_approved").alias("human_approved")), how="cross")
    )  # joins of single rows
    share, saved = savings(F.col("items"), F.col("codes"))
    return one.withColumn("duplicate_percent", share).withColumn("savings", saved)


def catalog_index(catalog: DataFrame) -> postings.Index:
    """Postings for ``filter_catalog`` and ``search``, by ``ord``."""
    return postings.build((catalog, "ord", [c for c in ("clean_description", "item_id", "raw_description") if c in catalog.columns]))


def registry_index(registry: DataFrame, mapping: DataFrame) -> postings.Index:
    """Postings for ``search``, by code."""
    return postings.build((registry, "cnmc_code", ["canonical_description", "cnmc_code"]), (mapping, "cnmc_code", ["original_code"]))


def filter_catalog(catalog: DataFrame, cpse: str | None = None, search: str | None = None, index: postings.Index | None = None) -> DataFrame:
    """Items of a source (any case) whose description or id holds ``search`` literally (any case); ``index`` narrows them first."""
    out = index.narrowed(catalog, "ord", [search]) if index and search else catalog
    if cpse:
        out = out.filter(F.upper("source_cpse") == cpse.upper())
    if search:
        q = F.lit(search.lower())
        out = out.filter(F.contains(F.lower("clean_description"), q) | F.contains(F.lower("item_id"), q) | F.contains(F.lower("raw_description"), q))
    return out


def filter_registry(registry: DataFrame, mapping: DataFrame, cpse: str | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Codes with their mappings, newest first; with a mapping of ``cpse`` (same case), created within the times."""
    out = registry
    if cpse:
        out = out.join(mapping.filter(F.col("source_cpse") == cpse), "cnmc_code", "left_semi")
    if start:
        out = out.filter(F.col("created_at") >= F.lit(start))
    if end:
        out = out.filter(F.col("created_at") <= F.lit(end))
    return with_mappings(out, mapping).orderBy(F.desc("created_at"), "cnmc_code")


def with_mappings(registry: DataFrame, mapping: DataFrame) -> DataFrame:
    nested = mapping.groupBy("cnmc_code").agg(F.array_sort(F.collect_list(F.struct("id", "source_cpse", "original_code"))).alias("mappings"))
    return registry.join(nested, "cnmc_code", "left").withColumn("mappings", F.coalesce("mappings", F.array().cast("array<struct<id:bigint,source_cpse:string,original_code:string>>")))


def filter_audit(audit: DataFrame, action: str | None = None) -> DataFrame:
    out = audit.filter(F.col("action") == action) if action else audit
    return out.orderBy(F.desc("timestamp"), F.desc("entry_id"))


def search(registry: DataFrame, mapping: DataFrame, catalog: DataFrame, q: str, indexes: tuple[postings.Index | None, postings.Index | None] = (None, None)) -> tuple[DataFrame, DataFrame]:
    """Codes by description, code or mapped code (``%`` and ``_`` are wildcards), with their sources; and the first ten
    catalog items that hold ``q`` literally.  ``indexes`` (of the registry, of the catalog) narrow both first."""
    like = f"%{q}%"
    codes, items = indexes
    if codes:
        registry, mapping = (codes.narrowed(t, "cnmc_code", postings.literal_runs(q)) for t in (registry, mapping))
    if items:
        catalog = items.narrowed(catalog, "ord", [q])
    own = mapping.filter(F.col("original_code").ilike(like)).select("cnmc_code", F.lit(True).alias("_hit")).distinct()
    hits = registry.join(own, "cnmc_code", "left").filter(F.col("canonical_description").ilike(like) | F.col("cnmc_code").ilike(like) | F.col("_hit"))
    sources = mapping.groupBy("cnmc_code").agg(F.array_sort(F.collect_set("source_cpse")).alias("sources"))
    low = F.lit(q.lower())
    items = catalog.filter(F.contains(F.lower("clean_description"), low) | F.contains(F.lower("item_id"), low)).orderBy("ord").limit(10)
    return with_mappings(hits.drop("_hit"), mapping).join(sources, "cnmc_code", "left"), items


def key_specifications(specs: str = "specs") -> Column:
    """``Size: …; Rating: …`` of what is known, else N/A."""
    s = lambda f: F.nullif(F.col(f"{specs}.{f}" if specs else f), F.lit(""))
    parts = [("Size", s("size")), ("Rating", s("pressure_rating")), ("Material", F.coalesce(s("material_grade"), s("material_family"))), ("Facing", s("facing")), ("Sch", s("schedule")), ("Power", s("power_hp")), ("Speed", s("speed_rpm"))]
    text = F.concat_ws("; ", *(F.when(v.isNotNull(), F.concat(F.lit(f"{n}: "), v)) for n, v in parts))
    return F.when(text == "", "N/A").otherwise(text)


@F.pandas_udf(StringType())
def two_places(x: pd.Series) -> pd.Series:
    """``%.2f`` of the number itself.  The JVM rounds its shortest decimal form instead: 0.285 is a little less, and gives 0.28."""
    return pd.Series([None if v is None or v != v else "%.2f" % v for v in x], dtype=object)


def sap_export(registry: DataFrame, mapping: DataFrame, catalog: DataFrame) -> DataFrame:
    """The migration table: one row for each mapping, by code; items that are not in the catalog keep their mapping."""
    items = catalog.select(F.upper("source_cpse").alias("_cpse"), F.col("item_id").alias("original_code"), "raw_description", "clean_description", "unit_of_measure", "category", "category_hint", "specs")
    rows = registry.join(mapping, "cnmc_code").withColumn("_cpse", F.upper("source_cpse")).join(items, ["_cpse", "original_code"], "left")
    full = lambda *c: F.coalesce(*(F.nullif(F.col(x), F.lit("")) for x in c))
    return rows.orderBy("cnmc_code", "id").select(
        F.col("cnmc_code").alias("CNMC_RECOMMENDED_CODE"),
        F.col("source_cpse").alias("SOURCE_CPSE"),
        F.col("original_code").alias("LEGACY_MATERIAL_CODE"),
        full("raw_description", "clean_description", "canonical_description").alias("ORIGINAL_DESCRIPTION"),
        F.col("canonical_description").alias("STANDARDIZED_DESCRIPTION"),
        F.coalesce("unit_of_measure", F.lit("EA")).alias("UOM"),
        F.coalesce("specs.category", "category_hint", F.lit("GENERAL")).alias("CATEGORY"),
        key_specifications().alias("KEY_SPECIFICATIONS"),
        two_places("confidence_at_merge").alias("CONFIDENCE_SCORE"),
        F.col("merge_type").alias("MERGE_TYPE"),
        F.lit("READY_FOR_SAP_ERP_IMPORT").alias("MAPPING_STATUS"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("EXPORT_TIMESTAMP"),
    )


def audit_export(audit: DataFrame) -> DataFrame:
    """The audit trail as a flat table, newest first."""
    d = lambda f: F.get_json_object("details", f"$.{f}")
    return audit.orderBy(F.desc("timestamp"), F.desc("entry_id")).select(
        F.col("entry_id").alias("ENTRY_ID"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("TIMESTAMP"),
        F.col("action").alias("ACTION"),
        F.coalesce(F.nullif("cnmc_code", F.lit("")), F.lit("N/A")).alias("CNMC_CODE"),
        F.col("actor").alias("ACTOR"),
        *(F.coalesce(d(f), F.lit("")).alias(f.upper()) for f in ("match_id", "item_a", "item_b", "confidence_score")),
        F.coalesce(F.nullif(d("reason"), F.lit("")), d("notes"), F.lit("")).alias("REASON_OR_NOTES"),
    )


def append_new(catalog: DataFrame, new: DataFrame, key: str = "item_id") -> DataFrame:
    """``catalog`` with the rows of ``new`` whose key it lacks; of equal keys in ``new``, the first by ``ord``."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), "ord").alias("_r")).select("_r.*")
    return catalog.unionByName(first.join(catalog.select(key), key, "left_anti"), allowMissingColumns=True)

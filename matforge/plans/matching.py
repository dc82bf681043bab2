"""From catalog items to match records, as one lazy plan.

Attributes and dense vectors are computed once for each item; pairs only look them up.  Cheap conditions come before Arrow
functions: source and category are in the join, the similarity filter comes before the gate.  The three text similarities are
computed for a batch of pairs at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, similarity, specs, text
from ..functions.dialect import column
from ..operators import analytics, candidates, classes, gate, registry
from ..sources import catalogs
from ..stages import saved, small, spread, staged


def enriched(items: DataFrame, encoder: similarity.Encoder = similarity.hashed_encoder) -> DataFrame:
    """Items with flat attributes, canonical material and a dense vector.

    Takes catalog rows (``specs`` nested) or plain ones (``ord, item_id, source_cpse, description, uom``).  What is missing or
    empty is derived from the description.
    """
    have = set(items.columns)
    pick = lambda *names: F.coalesce(*(F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in have), F.lit(""))
    base = items.withColumn("_raw", pick("raw_description", "description", "raw"))
    base = base.withColumn("_clean", pick("clean_description")).withColumn("_clean", F.when(F.col("_clean") != "", F.col("_clean")).otherwise(column(text.clean_or_empty("_raw"))))
    base = base.withColumn("_unit", pick("unit_of_measure", "uom", "unit")).withColumn("unit_of_measure", column(text.unit("_unit", "EA")))
    source = "_clean"
    keep = base.select("ord", "item_id", pick("source_cpse", "cpse").alias("source_cpse"), "unit_of_measure", F.col(source).alias("clean_description"), *(["specs"] if "specs" in have else []))
    flat = specs.extract(keep, "clean_description", matching=True)
    if "specs" in have:
        given = {f: F.when(F.col("specs").isNotNull(), F.array_join("specs.standards", ",") if f == "standards" else F.col(f"specs.{f}")).otherwise(F.col(f)) for f in specs.FIELDS}
        flat = flat.withColumns(given).drop("specs")
    ready = gate.prepared(flat.withColumn("category", F.coalesce("category", F.lit("OTHER"))))
    ready = ready.withColumn("expanded", column(text.expand_synonyms("clean_description")))
    return ready.withColumn("vector", similarity.encode("clean_description", encoder))


#: What is written of an item: items that are equal in these columns are one class.
WRITTEN = "raw_description description raw clean_description unit_of_measure uom unit source_cpse cpse specs".split()


def run(items: DataFrame, top_k: int = 15, strategy: str = "auto", encoder: similarity.Encoder = similarity.hashed_encoder) -> DataFrame:
    """Match records of ``items``, best first (ties: by item)."""
    found, members = classes.classed(items, [c for c in WRITTEN if c in items.columns])
    ready = staged(enriched(spread(found.withColumns({"ord": F.col("cls"), "item_id": F.col("cls").cast("string")}), "cls"), encoder))
    members = staged(members.select("ord", "item_id", "cls"))
    pairs = saved(_candidates(members, ready, top_k, candidates.chosen(members, strategy)))
    scored = pairs.select("cls_a", "cls_b").distinct().join(candidates.sided(ready, "a").withColumnRenamed("ord_a", "cls_a"), "cls_a").join(candidates.sided(ready, "b").withColumnRenamed("ord_b", "cls_b"), "cls_b")
    scored = spread(scored.filter(candidates.may_meet()), "cls_a", "cls_b")
    none = (F.col("clean_description_a") == "") | (F.col("clean_description_b") == "")
    scored = scored.withColumn("_s", similarity.text_scores("expanded_a", "expanded_b", "vector_a", "vector_b")).drop("vector_a", "vector_b")
    scored = scored.withColumn("semantic", similarity.semantic(similarity.dense_similarity(F.col("_s.dense")), F.col("_s.tfidf"), F.col("_s.fuzzy"), none)).drop("_s")
    likely = scored.filter(F.col("semantic") >= rules.PREFILTER)
    records = gate.match_records(staged(gate.decide(staged(gate.evaluate(likely)))))
    told = staged(records.drop("match_id").withColumns({f"cls_{s}": F.col(f"item_{s}").cast("long") for s in "ab"}).drop("item_a", "item_b"))
    out = classes.decided_pairs(pairs, told)
    for s in "ab":
        out = out.join(members.select(F.col("ord").alias(f"ord_{s}"), F.col("item_id").alias(f"item_{s}")), f"ord_{s}")
    out = out.withColumn("match_id", F.concat(F.lit("M-"), "item_a", F.lit("-"), "item_b"))
    return out.select(records.columns).orderBy(F.desc("confidence_score"), "item_a", "item_b")


def _candidates(members: DataFrame, ready: DataFrame, top_k: int, strategy: str) -> DataFrame:
    """``ord_a, ord_b, cls_a, cls_b``: pairs of items, as ``candidates.candidate_pairs`` has them, with their classes."""
    if strategy == "blocked":
        items = members.select("ord", "cls").join(small(ready.select(F.col("ord").alias("cls"), "category", "source_cpse")), "cls")
        return candidates.blocked_pairs(items).select("ord_a", "ord_b", "cls_a", "cls_b")
    vectors = ready.filter("exists(vector, x -> x <> 0)").select(F.col("ord").alias("cls"), F.col("vector").alias("v"))
    near = candidates.nearest_of_classes(members.select(F.col("ord").alias("id"), "cls"), vectors, top_k)
    first = F.col("id") < F.col("neighbour")
    one = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    return near.select(one("id", "neighbour", "ord_a"), one("neighbour", "id", "ord_b"), one("cls", "neighbour_cls", "cls_a"), one("neighbour_cls", "cls", "cls_b")).distinct()


def upload(spark: SparkSession, tables: registry.Tables, catalog: DataFrame, content: bytes, cpse: str, name: str, at) -> tuple[registry.Tables, DataFrame, DataFrame, DataFrame]:
    """One catalog file into the engine: new tables, the grown catalog, the matches and the report.

    Raises if the file is no CSV or has no valid row.
    """
    rows = catalogs.rows_of_bytes(spark, content, _csv(name)).persist()
    report = catalogs.report(rows, cpse)
    new = catalogs.standardized(rows, cpse)
    if new.isEmpty():
        raise ValueError("; ".join(report.first()["errors"]) or "no valid row")
    top = catalog.agg(F.max("ord")).first()[0] or 0
    grown = analytics.append_new(catalog, new.withColumn("ord", F.col("ord") + top)).persist()
    matches = run(grown).persist()
    ordered = registry.numbered(matches.withColumn("_o", F.struct(-F.col("confidence_score"), "item_a", "item_b")), 1, "_o").drop("_o").withColumnRenamed("number", "ord")
    tables, _ = registry.integrate(tables, ordered, grown, at)
    return tables, grown, matches, report


def _csv(name: str) -> str:
    if not (name or "").lower().endswith(".csv"):
        raise ValueError("only .csv files are taken")
    return name


def preview(spark: SparkSession, content: bytes, cpse: str, name: str = "upload.csv") -> tuple[DataFrame, DataFrame]:
    """The report and the first five valid rows; raises, as ``upload`` does, if the file is no CSV."""
    rows = catalogs.rows_of_bytes(spark, content, _csv(name))
    return catalogs.report(rows, cpse), catalogs.standardized(rows, cpse).orderBy("ord").limit(5)

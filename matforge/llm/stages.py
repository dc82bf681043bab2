"""The stages of the pipeline: each takes ``(spark, docs, sf_dir)``, works on all rows it gets and returns the columns of ``docs``;
``pack`` returns pieces.

Rows are decided one by one, or, near duplicates, by group; rows with null and repeated ids are rows like others.  Null texts
count as empty: they are not toxic, and of too low quality.  Extra columns are kept, whatever their names.  Empty tables give
empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, minhash, packing, quality, queries, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled rows of ``docs``, does not reject."""
    net = queries.toxicity_net(spark, docs, sf_dir)
    return toxicity.score_texts(docs, net, score="_toxicity").filter("_toxicity < 0.5").select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with enough content lines, words and variety."""
    field = queries.quality_field(spark, docs, sf_dir)
    return quality.judge_texts(docs, field, prefix="_quality_").filter("_quality_kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest id.
    Rows are decided one by one: null and repeated ids are no reason to go, and a row without an id stays if its group has none."""
    rows = common.written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered-rows")
    groups = minhash.near_duplicates(rows, doc_id="_row").select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_first")
    kept = rows.select("_row", "doc_id").join(groups, "_row").groupBy("component_id").agg(first).select(F.col("_first._row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts; ``n_chars`` follows the text."""
    clean = secrets.redact(docs, secrets.train(spark), path="source")
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, queries.word_bpe_path())

"""From raw documents to packed training sequences: toxicity, quality, near duplicates, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept and returns the columns of ``docs``; the
last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matforge.llm import common, stages


STAGES = [
    ("toxicity", stages.drop_toxic),
    ("quality", stages.drop_low_quality),
    ("near_duplicates", stages.drop_near_duplicates),
    ("secrets", stages.mask_secrets),
    ("packing", stages.pack),
]

#: The stages hold trained models and a tokenizer: no SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

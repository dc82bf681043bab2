"""Near duplicates of the pipeline are decided row by row."""

from pyspark.sql import functions as F

from matforge.llm import stages


def test_near_duplicates_by_row(spark):
    text = lambda g: " ".join(f"w{g}x{i}" for i in range(40))
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (7, text(2)), (7, text(3)), (9, text(4)), (8, text(4)), (None, text(4)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("other", F.lit(1))
    got = stages.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    key = lambda r: (str(r[0]), str(r[1]))
    want = [(None, text(0)), (None, text(1)), (7, text(2)), (7, text(3)), (8, text(4)), (None, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted(want, key=key)


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)), "en", "s", 90), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(1) for c in ("score", "kept", "id", "t", "component_id", "n_words")})
    for stage in (stages.drop_toxic, stages.drop_low_quality, stages.drop_near_duplicates, stages.mask_secrets):
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert stages.drop_near_duplicates(spark, docs, str(tmp_path)).count() == 2
    assert {r["doc_id"] for r in stages.pack(spark, docs, str(tmp_path)).collect()} == {1, None}

"""The registry in a SQL database, with the one that comes with Spark's jars."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from matforge.operators import registry
from matforge.sources.sqlstore import Refused, Store, connect

AT = datetime.datetime(2026, 3, 29, 2, 30)
COLUMNS = "ord long, match_id string, item_a string, item_b string, source_cpse_a string, source_cpse_b string, canonical_description string, confidence_score double"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(f"jdbc:derby:{tmp_path_factory.mktemp('derby')}/{uuid.uuid4().hex};create=true", splits=3)
    s.create(spark)
    return s


def rows(t):
    return {n: sorted(map(str, getattr(t, n).collect())) for n in registry.SCHEMAS}


def minted(spark, t, first=0):
    matches = [(i, f"M{i}", f"I{first + i}", f"J{first + i}", "S", "T", f"item, 'x' {i} ü", 0.9) for i in range(20)]
    return registry.mint(t, spark.createDataFrame(matches, COLUMNS), "auto_linked", "tester", AT)


def test_store_of_sql_tables(spark, store, tmp_path):
    assert [getattr(store.load(spark), n).count() for n in registry.SCHEMAS] == [0, 0, 0, 0]
    t = minted(spark, registry.empty(spark))
    decided = spark.createDataFrame([("M1", "approved", "approved", "me", AT, None)], registry.DECISIONS)
    t.decisions = t.decisions.unionByName(decided)
    store.save(t)
    names = spark.read.format("jdbc").options(url=store.url, query="SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'").load()
    assert {r[0] for r in names.collect()} == set(registry.SCHEMAS)  # nothing staged is left
    loaded = store.load(spark)
    assert rows(loaded) == rows(t)
    assert [getattr(loaded, n).schema.simpleString() for n in registry.SCHEMAS] == [getattr(t, n).schema.simpleString() for n in registry.SCHEMAS]
    assert loaded.mapping.rdd.getNumPartitions() == 3
    plan = loaded.mapping.filter("source_cpse = 'S'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source_cpse,S)" in plan
    # a session more: what was loaded is minted on and stored again
    more = minted(spark, loaded, first=15)
    want = rows(more)
    store.save(more)
    assert rows(store.load(spark)) == want
    # rows that break a rule leave everything as it was
    for broken in (
        {"mapping": more.mapping.withColumn("original_code", F.lit("same"))},
        {"mapping": more.mapping.withColumn("cnmc_code", F.lit("CNMC-999999"))},
        {"audit": more.audit.withColumn("action", F.lit("guessed"))},
    ):
        with pytest.raises(Refused):
            store.save(registry.Tables(**{n: broken.get(n, getattr(more, n)) for n in registry.SCHEMAS}))
        assert rows(store.load(spark)) == want
    assert connect(spark, store, str(tmp_path / "none"))[1] == "sql"


def test_fallback_to_a_folder(spark, tmp_path):
    path = str(tmp_path / "registry")
    registry.save(minted(spark, registry.empty(spark)), path)
    t, kind = connect(spark, Store(f"jdbc:derby:{tmp_path}/absent"), path)
    assert kind == "folder" and t.registry.count() == 20

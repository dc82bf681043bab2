"""Minting against a plain fold, and registries stored as versions."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from matforge.operators import registry
from matforge.sources import versions

AT = datetime(2024, 1, 2)
COLUMNS = "ord long, match_id string, item_a string, item_b string, source_cpse_a string, source_cpse_b string, canonical_description string, confidence_score double"


def table(spark, pairs):
    rows = [(i, f"M{i}", a, b, "S", "T", f"d{i}", 0.9) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, COLUMNS)


def fold(pairs, codes=None, n=0):
    """One match after the other: items by code, and what each match does."""
    codes, effects = dict(codes or {}), []
    for i, (a, b) in enumerate(pairs):
        a, b = ("S", a), ("T", b)
        if a not in codes and b not in codes:
            n += 1
            codes[a] = codes[b] = f"CNMC-{n:06d}"
            effects.append(i)
        elif a not in codes or b not in codes:
            codes[a] = codes[b] = codes.get(a) or codes[b]
            effects.append(i)
    return codes, effects, n


def minted(spark, pairs, t=None):
    t = registry.mint(t or registry.empty(spark), table(spark, pairs), "auto_linked", "x", AT)
    return t, {(r["source_cpse"], r["original_code"]): r["cnmc_code"] for r in t.mapping.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_random_matches(spark, seed):
    rnd = random.Random(seed)
    some = lambda n: [(f"i{rnd.randrange(40)}", f"j{rnd.randrange(40)}") for _ in range(n)]
    one, two = some(30), some(80)
    want, effects, n = fold(one)
    t, got = minted(spark, one)
    assert got == want and t.audit.count() == len(effects) and t.registry.count() == n
    more, again, m = fold(two, want, n)
    t, got = minted(spark, two, t)
    assert got == more and t.audit.count() == len(effects) + len(again) and t.registry.count() == m
    assert sorted(r["id"] for r in t.mapping.select("id").collect()) == list(range(1, len(more) + 1))
    assert registry.violations(t).isEmpty()


def chain(n):
    """Each match shares an item with the one before: i0-j0, i1-j0, i1-j1, ..."""
    return [(f"i{(k + 1) // 2}", f"j{k // 2}") for k in range(n)]


def test_chain_and_star_of_a_hundred_thousand(spark):
    n = 100_000
    same = [F.concat(F.lit("M"), "id").alias("match_id"), F.lit("S").alias("source_cpse_a"), F.lit("T").alias("source_cpse_b"), F.lit("d").alias("canonical_description"), F.lit(0.9).alias("confidence_score")]
    one = lambda a, b: spark.range(n).select(F.col("id").alias("ord"), F.expr(a).alias("item_a"), F.expr(b).alias("item_b"), *same)
    long = registry.mint(registry.empty(spark), one("concat('i', (id + 1) div 2)", "concat('j', id div 2)"), "auto_linked", "x", AT)
    assert fold(chain(1000))[2] == 1
    assert long.mapping.groupBy("cnmc_code").count().collect() == [("CNMC-000001", n + 1)]
    assert long.audit.count() == n and long.registry.count() == 1
    # matches in the other direction meet an item that is new on both sides only at the end of each pair
    back = registry.mint(registry.empty(spark), one(f"concat('i', ({n} - id) div 2)", f"concat('j', ({n} - 1 - id) div 2)"), "auto_linked", "x", AT)
    assert back.mapping.groupBy("cnmc_code").count().collect() == [("CNMC-000001", n + 1)]
    star = registry.mint(registry.empty(spark), one("'hub'", "concat('j', id)"), "auto_linked", "x", AT)
    assert star.mapping.groupBy("cnmc_code").count().collect() == [("CNMC-000001", n + 1)]
    assert star.registry.count() == 1


def test_load_mint_save_load(spark, tmp_path):
    path = f"{tmp_path}/registry"
    with pytest.raises(FileNotFoundError):
        registry.load(spark, path)
    want, _, n = fold([("a", "b"), ("c", "d")])
    t, _ = minted(spark, [("a", "b"), ("c", "d")])
    registry.save(t, path)
    t = registry.load(spark, path)
    _, got = minted(spark, [("e", "b"), ("f", "g")], t)
    t, _ = minted(spark, [("e", "b"), ("f", "g")], t)
    registry.save(t, path)
    t = registry.load(spark, path)
    assert {(r["source_cpse"], r["original_code"]): r["cnmc_code"] for r in t.mapping.collect()} == got == fold([("e", "b"), ("f", "g")], want, n)[0]
    assert t.registry.count() == 3 and len(versions.listed(spark, path)) == 2
    registry.drop(spark, path)
    assert registry.load(spark, path).mapping.isEmpty()


def test_failure_halfway_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/registry"
    add = lambda pairs: lambda t: minted(spark, pairs, t)[0]
    t = registry.transact(spark, path, add([("a", "b")]))
    name = t.version

    def fails(t):
        raise KeyError("an item is not known")

    with pytest.raises(KeyError):
        registry.transact(spark, path, add([("c", "d")]), fails)
    # a table that cannot be written, after others were
    bad = registry.replace(t, decisions=spark.range(1).select(*(F.raise_error(F.lit("lost")).cast(f.dataType).alias(f.name) for f in t.decisions.schema)))
    with pytest.raises(Exception, match="lost"):
        registry.save(bad, path)
    again = registry.load(spark, path)
    assert again.version == name and again.mapping.count() == 2
    assert versions.sweep(spark, path, keep=0) and versions.listed(spark, path) == [name]
    assert registry.load(spark, path).mapping.count() == 2


def test_conflict_and_broken_rules(spark, tmp_path):
    path = f"{tmp_path}/registry"
    registry.transact(spark, path, lambda t: minted(spark, [("a", "b")], t)[0])
    one, two = registry.load(spark, path), registry.load(spark, path)
    registry.save(minted(spark, [("c", "d")], one)[0], path)
    with pytest.raises(versions.Conflict):
        registry.save(minted(spark, [("e", "f")], two)[0], path)
    twice = lambda t: registry.replace(t, mapping=t.mapping.unionByName(t.mapping))
    with pytest.raises(registry.Broken):
        registry.transact(spark, path, twice)
    assert registry.load(spark, path).mapping.count() == 4

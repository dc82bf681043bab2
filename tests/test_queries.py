"""Registered queries over small tables, against plain folds."""

from matforge.plans import matching


def test_mint_codes_across_blocks(spark, tmp_path):
    from matforge.plans import queries  # needs a session

    spark.range(1, 81).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    items = queries._items(spark, str(tmp_path)).select("ord", "item_id", "source_cpse", "description", "uom").persist()
    records = matching.run(items, strategy="blocked").filter("status = 'auto_linked'").collect()
    codes, n = {}, 0
    for r in sorted(records, key=lambda r: (-r["confidence_score"], r["item_a"], r["item_b"])):
        a, b = (r["source_cpse_a"], r["item_a"]), (r["source_cpse_b"], r["item_b"])
        if a not in codes and b not in codes:
            n += 1
            codes[a] = codes[b] = f"CNMC-{n:06d}"
        elif a not in codes or b not in codes:
            codes[a] = codes[b] = codes.get(a) or codes[b]
    got = {(r["source_cpse"], r["original_code"]): r["cnmc_code"] for r in queries.QUERIES["mint_codes"](spark, str(tmp_path)).collect()}
    assert got == codes
    block = {(r["source_cpse"], r["item_id"]): r["ord"] // 40 for r in items.collect()}
    spread = {}
    for item, code in got.items():
        spread.setdefault(code, set()).add(block[item])
    assert any(len(blocks) > 1 for blocks in spread.values())

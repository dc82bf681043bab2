"""The two older scorers: token sets and a corpus-wide n-gram weighting with a gate, or dense vectors without one.

Weights of n-grams are a long table, ``ord, k, w``: sparse, and without a bound on how many grams there are.  All pairs are the
definition of both scorers.  Where only pairs of some confidence are wanted, an inverted index of the heaviest part of each item
finds them without comparing all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, similarity
from ..stages import saved, staged
from .candidates import cross_source_pairs, sided

#: Patterns of specification tokens; the number says which group is the token (0: the whole match).
TOKENS_A = [(r"\d+\s?(in|inch|IN|NB)", 1), (r"api\s?6d", 0), (r"asme\s?b16\.\d+", 0)]
TOKENS_B = [
    (r"\d+#", 0), (r"class\s?\d+", 0), (r"\d+\s?(in|inch|IN|NB)", 1), (r"A\d{3}(\s?[A-Z0-9]+)?", 1), (r"F\d{3}", 0), (r"WCB", 0),
    (r"api\s?6d", 0), (r"asme\s?b16\.\d+", 0), (r"\d+\s?(hp|HP)", 1), (r"\d+\s?(v|V)", 1),
]


def tokens(x: str, patterns: list[tuple[str, int]]) -> Column:
    """The distinct tokens of a description, in lower case without white space."""
    found = F.concat(*(F.regexp_extract_all(F.col(x), F.lit(f"(?i){p}"), F.lit(g)) for p, g in patterns))
    return F.array_distinct(F.transform(found, lambda t: F.lower(F.regexp_replace(t, r"\s+", ""))))


def safety_attributes(x: str) -> tuple[Column, Column]:
    """Pressure class and material grade, in upper case."""
    p = lambda g: F.nullif(F.regexp_extract(x, f"(?i){rules.PROTOTYPE_PRESSURE}", g), F.lit(""))
    return F.upper(F.coalesce(p(1), p(2))), F.nullif(F.upper(F.trim(F.regexp_extract(x, f"(?i){rules.PROTOTYPE_GRADE}", 1))), F.lit(""))


def unit_score(a: str, b: str) -> Column:
    """Units by exact spelling; two unknown ones are equal."""
    table = F.create_map(*[F.lit(v) for kv in rules.PROTOTYPE_UNITS.items() for v in kv])
    known = lambda c: F.try_element_at(table, F.col(c))
    return F.when(known(a).eqNullSafe(known(b)), 1.0).otherwise(0.4)


def corpus_weights(items: DataFrame, x: str = "description") -> DataFrame:
    """``ord, k, w, df``: character n-grams weighted by count and rarity over the whole corpus, each item of length 1.

    Rarity is ``ln((1 + items) / (1 + df)) + 1``.  An item may stand for several of one description (``n``, 1 if there is none).
    Items without a gram have no rows.
    """
    n = F.col("n") if "n" in items.columns else F.lit(1)
    rows = items.select("ord", n.cast("long").alias("n"), similarity.grams(f"lower(coalesce({x}, ''))").alias("g"))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    long = rows.select("ord", "n", F.explode("g").alias("e")).select("ord", "n", F.col("e.k").alias("k"), F.col("e.n").alias("c"))
    rarity = long.groupBy("k").agg(F.sum("n").alias("df")).withColumn("idf", F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.col("df"))) + 1)
    weighed = long.join(rarity, "k").select("ord", "k", "df", (F.col("c") * F.col("idf")).alias("w"))
    norms = weighed.groupBy("ord").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, "ord").select("ord", "k", (F.col("w") / F.col("norm")).alias("w"), "df")


def corpus_vectors(items: DataFrame, weights: DataFrame) -> DataFrame:
    """``items`` with ``tfidf``: the entries ``k, w`` of their weights in the order of ``k``."""
    vectors = weights.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("tfidf"))
    return items.join(vectors, "ord", "left").withColumn("tfidf", F.coalesce("tfidf", F.expr("cast(array() as array<struct<k:string,w:double>>)")))


def sparse_dot(a: str, b: str) -> Column:
    """Dot product of two entry columns; both are merged in the order of their grams, so that shared ones lie together."""
    merged = f"array_sort(concat({a}, {b}))"
    shared = "filter(sequence(1, size(m) - 1), i -> m[i].k = m[i - 1].k)"
    dot = f"aggregate({shared}, 0D, (t, i) -> t + m[i - 1].w * m[i].w)"
    return F.expr(f"IF(size({a}) = 0 OR size({b}) = 0, 0D, transform(array({merged}), m -> {dot})[0])")


def similar_candidates(weights: DataFrame, least: float, rows: int = 1024) -> DataFrame:
    """``ord_a, ord_b``: pairs among which are all whose cosine is ``least`` or more (above 0).

    Grams are taken in one order for all items, rare ones first.  Behind some gram, the weight that remains to an item is too
    small: even a partner that shares all of it stays below ``least``.  So two similar items share a gram before that place in
    both, and only these grams are posted.  A gram with very many postings is dealt into blocks of about ``rows``.
    """
    order = Window.partitionBy("ord").orderBy(F.desc("df"), F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    remaining = weights.withColumn("left", F.sum(F.col("w") * F.col("w")).over(order))
    posted = saved(remaining.filter(F.col("left") >= least * least * (1 - 1e-9)).select("k", "ord"))
    sizes = posted.groupBy("k").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = posted.join(sizes, "k", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = dealt.select("k", F.pmod(F.xxhash64("ord"), F.col("blocks")).cast("int").alias("block"), F.col("ord").alias("ord_a"))
    other = dealt.select("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("ord").alias("ord_b"))
    return own.join(other, ["k", "block"]).filter("ord_a < ord_b").select("ord_a", "ord_b").distinct()


def prepared(items: DataFrame, gate: bool = True) -> DataFrame:
    """``items`` with attributes and tokens."""
    pressure, grade = safety_attributes("description")
    return items.withColumns({"pressure_class": pressure, "material_grade": grade, "tokens": tokens("description", TOKENS_A if gate else TOKENS_B)})


def classes(items: DataFrame) -> DataFrame:
    """Items that the scorers cannot tell apart, by their first one: ``ord, item_id, source_cpse, description, unit, n``."""
    alike = items.groupBy("source_cpse", "description", "unit").agg(F.min(F.struct("ord", "item_id")).alias("x"), F.count("*").alias("n"))
    return alike.select("x.ord", "x.item_id", "source_cpse", "description", "unit", "n")


def score(items: DataFrame, gate: bool = True, least: float | None = None) -> DataFrame:
    """Scored pairs of ``ord, item_id, source_cpse, description, unit``, best first; items of no or equal source do not pair.

    ``gate``: n-gram text score and a block where pressure class or grade differ; else dense vectors and no block.  ``least``
    (with ``gate``): only pairs of at least this confidence, found through the index where it lies above what pairs without
    a shared gram can reach; without it all pairs, whose number is quadratic.
    """
    prep = prepared(items, gate)
    if gate:
        weights = staged(corpus_weights(items))
        prep = staged(corpus_vectors(prep, weights))
        dot = sparse_dot("tfidf_a", "tfidf_b")
    else:
        prep = prep.withColumn("tfidf", similarity.encode("description").cast("array<double>"))
        dot = F.expr("aggregate(zip_with(tfidf_a, tfidf_b, (x, y) -> x * y), 0D, (t, x) -> t + x)")
    # confidence is 0.35 cosine, and at most 0.15 + 0.3 + 0.2 of all else; half a unit of the last place is rounding
    floor = None if least is None else (least - 0.0005 - 0.65) / 0.35
    if gate and floor is not None and floor > 0:
        known = prep.filter("source_cpse is not null")
        pairs = similar_candidates(weights.join(known.select("ord"), "ord", "left_semi"), floor)
        pairs = pairs.join(sided(known, "a"), "ord_a").join(sided(known, "b"), "ord_b").filter("source_cpse_a <> source_cpse_b")
        pairs = pairs.withColumn("_dot", dot).filter(F.col("_dot") >= floor)
        dot = F.col("_dot")
    else:
        pairs = cross_source_pairs(prep)
    scored = pairs.withColumn("text_score", F.lit(0.7) * dot + F.lit(0.3) * similarity.sort_ratio("description_a", "description_b"))
    scored = scored.withColumn("spec_score", similarity.jaccard("tokens_a", "tokens_b")).withColumn("unit_score", unit_score("unit_a", "unit_b"))
    scored = scored.withColumn("confidence", F.bround(0.5 * F.col("text_score") + 0.3 * F.col("spec_score") + 0.2 * F.col("unit_score"), 3))
    if least is not None:
        scored = scored.filter(F.col("confidence") >= least)
    differs = lambda c: F.when(F.col(f"{c}_a") != F.col(f"{c}_b"), F.concat(F.lit(f"{c} differs: "), f"{c}_a", F.lit(" vs "), f"{c}_b"))
    scored = scored.withColumn("block_reason", F.coalesce(differs("pressure_class"), differs("material_grade"), F.lit("")) if gate else F.lit(""))
    status = F.when(F.col("block_reason") != "", "safety_gate_blocked").when(F.col("confidence") >= rules.AUTO_LINK, "auto_linked").otherwise("needs_review")
    more = ["n_a", "n_b"] if "n" in items.columns else []
    return scored.select(F.col("item_id_a").alias("item_a"), F.col("item_id_b").alias("item_b"), *more, F.bround("text_score", 3).alias("text_score"), "spec_score", "unit_score", "confidence", status.alias("status"), "block_reason").orderBy(F.desc("confidence"), "item_a", "item_b")

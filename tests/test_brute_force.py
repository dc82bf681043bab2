"""Registered queries without SQL against plain re-computations of the same definitions."""

import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from matforge.functions import similarity
from matforge.operators import candidates
from matforge.plans import matching

TEXTS = ["Gate Valve 4 IN CS Class 150", "GATE VALVE 4\" CS 150#", "Ball valve 2 inch SS316 800#", "", None, "Gate Valve 4 IN CS Class 150", "pump 5 HP 415V", "a b", "b  a"]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_ratio(a, b):
    return 2 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def plain_set_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if common and (not left or not right):
        return 1.0
    one, two = f"{common} {left}".strip(), f"{common} {right}".strip()
    # the rests are aligned behind the common part
    best = 1 - (len(left) + len(right) - 2 * plain_lcs(left, right)) / (len(one) + len(two))
    return max([best] + ([plain_ratio(common, one), plain_ratio(common, two)] if common else []))


def plain_grams(t):
    out = Counter()
    for w in re.split(r"\s+", t):
        if w:
            w = f" {w} "
            for n in (2, 3, 4):
                out.update([w[i : i + n] for i in range(len(w) - n + 1)] if len(w) >= n else ([w] if n < 4 else []))
    return out


def plain_tfidf(a, b):
    x, y = plain_grams(a), plain_grams(b)
    weight = lambda k: 1.0 if k in x and k in y else similarity.ONE_SIDED
    dot = sum(x[k] * y[k] for k in x)
    norm = math.sqrt(sum((x[k] * weight(k)) ** 2 for k in x) * sum((y[k] * weight(k)) ** 2 for k in y))
    return dot / norm if norm else 0.0


def test_token_ratio(spark):
    pairs = [(a, b) for a, b in combinations(TEXTS, 2)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: r["s"] for r in df.select("i", similarity.token_ratio("a", "b").alias("s")).collect()}
    for i, (a, b) in enumerate(pairs):
        a, b = a or "", b or ""
        sort = plain_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
        assert got[i] == pytest.approx((plain_set_ratio(a, b) + sort) / 2, abs=1e-9), (a, b)


@pytest.fixture(scope="module")
def items(spark):
    from matforge.plans import queries

    path = "/root/testdata/sf0.001"
    return queries._items(spark, path).filter("ord <= 130").select("ord", "item_id", "source_cpse", "description", "uom").persist()


def test_dense_match(spark, items):
    """Candidates by a plain nearest-neighbour search, similarities by plain definitions."""
    ready = matching.enriched(items).select("ord", "item_id", "source_cpse", "category", "clean_description", "expanded", "vector").collect()
    v = np.array([r["vector"] for r in ready], float)
    ids = np.array([r["ord"] for r in ready])
    s = np.round(v @ v.T, 12)
    np.fill_diagonal(s, -9)
    near = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in np.lexsort((ids, -s[i]))[:15]}
    by = {r["ord"]: r for r in ready}
    want = {}
    for a, b in near:
        x, y = by[a], by[b]
        if x["source_cpse"] == y["source_cpse"] or not (x["category"] == y["category"] or "OTHER" in (x["category"], y["category"])):
            continue
        fuzzy = (plain_set_ratio(x["expanded"], y["expanded"]) + plain_ratio(" ".join(sorted(x["expanded"].split())), " ".join(sorted(y["expanded"].split())))) / 2
        dense = min(1.0, max(0.0, round(float(np.float64(x["vector"]) @ np.float64(y["vector"])), 4)))
        mix = 0.5 * dense + 0.25 * plain_tfidf(x["expanded"], y["expanded"]) + 0.25 * fuzzy
        if mix >= 0.2:
            want[x["item_id"], y["item_id"]] = mix
    got = {(r["item_a"], r["item_b"]): r["score_breakdown"]["text_similarity"] for r in matching.run(items, strategy="nearest").collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) <= 0.00051


def test_blocks_meet_once(spark):
    rows = [(i, f"I{i}", ["VALVE", "OTHER", "PUMP", None][i % 4], ["A", "B", "", None][i // 4 % 4]) for i in range(200)]
    df = spark.createDataFrame(rows, "ord long, item_id string, category string, source_cpse string")
    got = sorted((r["ord_a"], r["ord_b"]) for r in candidates.blocked_pairs(df, rows=16).collect())
    kind = lambda r: r[2] or "OTHER"
    want = sorted((a[0], b[0]) for a, b in combinations(rows, 2) if (kind(a) == kind(b) or "OTHER" in (kind(a), kind(b))) and not (a[3] and a[3] == b[3]))
    assert got == want
    assert candidates.blocked_pairs(df.filter("false")).isEmpty()
    counts = Counter(kind(next(r for r in rows if r[0] == a)) for a, _ in want)
    assert {r["category"]: r["pairs"] for r in candidates.blocked_counts(df).collect()} == counts
    assert candidates.blocked_counts(df.filter("false")).isEmpty()


def test_prototype_scores(spark):
    """The older scorer's decisions on pairs whose outcome its definition fixes."""
    from matforge.operators import prototypes

    rows = [(1, "a", "X", "Flange WN RF 150# A105 6IN", "EA"), (2, "b", "Y", "Flange WN RF 150# A105 6IN", "Nos"), (3, "c", "Y", "Flange WN RF 300# A105 6IN", "EA")]
    df = spark.createDataFrame(rows, "ord long, item_id string, source_cpse string, description string, unit string")
    got = {(r["item_a"], r["item_b"]): r for r in prototypes.score(df).collect()}
    assert got.keys() == {("a", "b"), ("a", "c")}
    assert got["a", "b"]["status"] == "auto_linked" and got["a", "b"]["confidence"] == 1.0
    assert got["a", "c"]["status"] == "safety_gate_blocked" and got["a", "c"]["block_reason"] == "pressure_class differs: 150 vs 300"
    open_ = {(r["item_a"], r["item_b"]): r for r in prototypes.score(df, gate=False).collect()}
    assert open_["a", "c"]["block_reason"] == ""


def plain_corpus(texts):
    """Unit vectors of n-grams weighted by smooth rarity over all texts."""
    counts = [plain_grams(t.lower()) for t in texts]
    df = Counter(k for c in counts for k in c)
    out = []
    for c in counts:
        v = {k: n * (math.log((1 + len(texts)) / (1 + df[k])) + 1) for k, n in c.items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        out.append({k: w / norm for k, w in v.items()} if norm else {})
    return out


def plain_dot(x, y):
    return sum(w * y.get(k, 0.0) for k, w in x.items())


def test_corpus_weights(spark):
    """Cosines over four texts, different ones, as the weighting defines them; nothing for an empty text."""
    from matforge.operators import prototypes

    texts = ["Gate Valve 4 IN CS", "Gate valve 6 inch SS316", "Ball Valve 2IN A105", "Welding Electrode E6013", "", "gate VALVE 4 in cs"]
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, description string")
    items = prototypes.corpus_vectors(df, prototypes.corpus_weights(df))
    a, b = (items.select(*(items[c].alias(f"{c}_{s}") for c in ("ord", "tfidf"))) for s in "ab")
    got = {(r["ord_a"], r["ord_b"]): r["d"] for r in a.join(b, a.ord_a < b.ord_b).select("ord_a", "ord_b", prototypes.sparse_dot("tfidf_a", "tfidf_b").alias("d")).collect()}
    want = plain_corpus(texts)
    for (i, j), d in got.items():
        assert d == pytest.approx(plain_dot(want[i], want[j]), abs=1e-12), (i, j)
    assert 0.2 < got[0, 1] < 0.8 and got[0, 5] == pytest.approx(1.0)


def test_index_finds_all_similar_pairs(spark):
    import random

    from matforge.operators import prototypes

    rnd = random.Random(6)
    words = ["gate", "valve", "ball", "flange", "cs", "ss316", "150#", "300#", "4in", "6in", "raised", "face", "pump", "motor"]
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(1, 7))) for _ in range(150)] + ["gate valve"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, description string")
    v = plain_corpus(texts)
    w = prototypes.corpus_weights(df).persist()
    for least in (0.3, 0.6, 0.95):
        got = {(r["ord_a"], r["ord_b"]) for r in prototypes.similar_candidates(w, least, rows=16).collect()}
        want = {(i, j) for i, j in combinations(range(len(texts)), 2) if plain_dot(v[i], v[j]) >= least}
        assert want <= got and len(got) < len(texts) * (len(texts) - 1) // 2
    w.unpersist()


def test_least_confidence_gives_the_same_pairs(spark):
    from matforge.operators import prototypes

    sizes, kinds = ["2IN", "4IN", "6IN"], ["Gate Valve {} A105 150# API 6D", "GATE VALVE {} WCB 300# api 6d", "Flange WN RF {} 150# A105", "Welding Electrode {}"]
    rows = [(i, f"I{i}", ["X", "Y", "Z", None][i % 4], kinds[i % 7 % 4].format(sizes[i % 3]), ["EA", "Nos", None][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "ord long, item_id string, source_cpse string, description string, unit string")
    every = prototypes.score(df).collect()
    for least in (0.7, 0.85):
        assert prototypes.score(df, least=least).collect() == [r for r in every if r["confidence"] >= least]
    grouped = prototypes.score(prototypes.classes(df), least=0.85).collect()
    assert sum(r["n_a"] * r["n_b"] for r in grouped) == sum(r["confidence"] >= 0.85 for r in every)


def test_more_grams_than_a_vocabulary(spark):
    """Beyond 262,144 distinct n-grams none is lost."""
    import random

    from matforge.operators import prototypes

    rnd = random.Random(7)
    signs = [chr(0x4E00 + i) for i in range(3000)]
    texts = [" ".join("".join(rnd.choices(signs, k=12)) for _ in range(300)) for _ in range(40)]
    texts.append(texts[0] + " " + texts[1])
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, description string")
    w = prototypes.corpus_weights(df).persist()
    assert w.select("k").distinct().count() > 262_144
    v = plain_corpus(texts)
    got = {r["ord"]: {e["k"]: e["w"] for e in r["tfidf"]} for r in prototypes.corpus_vectors(df, w).filter("ord in (0, 1, 40)").collect()}
    w.unpersist()
    for i in (0, 1):
        assert plain_dot(got[i], got[40]) == pytest.approx(plain_dot(v[i], v[40]), abs=1e-9)


def test_batches_of_ratios():
    """Pairs of all lengths around the borders of 64-bit words, in one batch."""
    import random

    rnd = random.Random(8)
    texts = ["", "a", "日本" * 40] + ["".join(rnd.choices("ab cdé", k=k)) for k in (1, 2, 5, 62, 63, 64, 65, 66, 127, 128, 129, 130, 200)]
    a, b = zip(*[(x, y) for x in texts for y in texts])
    for room in (1, 2000, 1 << 22):
        assert similarity.lcs_lengths(list(a), list(b), room).tolist() == [plain_lcs(x, y) for x, y in zip(a, b)]
    assert similarity.ratios(list(a), list(b)) == pytest.approx([plain_ratio(x, y) for x, y in zip(a, b)])
    assert similarity.pair_cosines(list(a), list(b)) == pytest.approx([plain_tfidf(x, y) for x, y in zip(a, b)], abs=1e-12)
    assert similarity.lcs_lengths([], []).tolist() == []

"""Phrases against a plain count."""

import random
import re
from collections import Counter

from matforge.llm import collocations

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, s):
    f, n, out = Counter(), Counter(), []
    for text, lang in rows:
        lang = lang if lang is not None else s.unknown
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, s.longest + 1) for i in range(len(w) - k + 1))
    most = Counter()
    for (lang, w), a in f.items():
        if a >= s.least:
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    most[lang, w[i : i + k]] = max(most[lang, w[i : i + k]], a)
    for lang in n:
        held = []
        for (g, w), a in f.items():
            if g == lang and len(w) >= 2 and a >= s.least and 100 * most[g, w] < s.covered * a:
                score, k, l, r = min((s.scale * a // (f[g, w[:k]] + f[g, w[k:]]), k, f[g, w[:k]], f[g, w[k:]]) for k in range(1, len(w)))
                held.append((-score, -a, " ".join(w).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -score) for i, (score, a, p, l, r) in enumerate(sorted(held)[: s.best])]
    return sorted(out)


def check(spark, rows, **changed):
    s = collocations.Settings()._replace(**changed)
    df = spark.createDataFrame([(t, g, "x", 1) for t, g in rows], "text string, lang string, phrase string, n int").repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(df, s).collect())
    assert got == plain(rows, s)
    return got


def words(rnd, n, names):
    return "".join(rnd.choice(names) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n"]) for _ in range(n))


def test_counts(spark):
    rnd = random.Random(1)
    names = ["the", "of", "New", "york", "CITY", "état", "É", "a-b", "x", " ", "naïve"] + [f"w{i}" for i in range(30)]
    rows = [(words(rnd, rnd.randrange(0, 80), names[: rnd.choice([6, 41])]), rnd.choice(["en", "fr", None])) for _ in range(300)]
    rows += [("Copied line of the day. " * 5, "en")] * 40 + [(None, "en"), ("", None), (" \t ,;", "zz"), ("a a a a a a a a a " * 50, "en")]
    assert len(check(spark, rows, least=5)) > 100
    check(spark, rows, least=5, best=7)


def test_small_bitmap_loses_nothing(spark):
    """With a bitmap of 32 places nearly all phrases collide: more is counted, the result is the same."""
    rnd = random.Random(2)
    rows = [(words(rnd, 60, [f"w{i}" for i in range(12)]), "en") for _ in range(60)]
    assert check(spark, rows, least=4, filter_bits=5) == check(spark, rows, least=4)


def test_small_chunks_and_one_long_piece(spark):
    rnd = random.Random(3)
    rows = [(" ".join(rnd.choices(["p", "q", "r", "s"], k=5000)), "en"), (words(rnd, 400, ["p", "q", "r"]), "en")]
    check(spark, rows, least=10, chunk=64)


def test_spills(spark):
    rnd = random.Random(4)
    rows = [(words(rnd, 200, [f"w{i}" for i in range(9)]), "en") for _ in range(50)]
    check(spark, rows, least=5, memory="20MB")


def test_hot_copies_and_empty(spark):
    rows = [("hot phrase here", "en")] * 900 + [(f"hot word{i} here", "en") for i in range(450)]
    got = check(spark, rows)
    assert [r[2] for r in got] == ["hot phrase here"]
    assert check(spark, []) == [] and check(spark, [(None, None)]) == []


def test_exact_beyond_64_bits(spark):
    """Counts whose products pass 64 bits, as no fixture could hold them."""
    big = 1 << 60
    frequent = spark.createDataFrame([("en", "a", 1, big + 1), ("en", "b", 1, big), ("en", "a b", 2, big - 1)], "lang string, phrase string, n int, f long")
    r = collocations.scored(frequent, collocations.Settings()).collect()[0]
    assert r["score"] == 2_000_000 * (big - 1) // (2 * big + 1) and (r["l"], r["r"]) == (big + 1, big)

"""Text similarity of pairs: character n-grams, token ratios, dense vectors, and their mix."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

DIM = 384
ONE_SIDED = math.log(1.5) + 1  # smooth inverse frequency, over two texts, of what only one of them has


def grams(x: str) -> Column:
    """Character n-grams (2 to 4) inside words padded by spaces, as entries ``k`` (gram) and ``n`` (count).

    A word shorter than ``n`` counts once as a whole.  Entries are in the order of their grams.  Compute it once for an item,
    not for each pair.
    """
    # a padded word has three characters or more: only n = 4 can be longer than it
    four = "IF(length(w) <= 4, IF(length(w) = 4, array(w), array()), transform(sequence(1, length(w) - 3), i -> substring(w, i, 4)))"
    three = "IF(length(w) = 3, array(w), transform(sequence(1, length(w) - 2), i -> substring(w, i, 3)))"
    two = "transform(sequence(1, length(w) - 1), i -> substring(w, i, 2))"
    words = f"transform(filter(split({x}, '\\\\s+'), t -> t <> ''), t -> concat(' ', t, ' '))"
    all_ = f"array_sort(flatten(transform({words}, w -> concat({two}, {three}, {four}))))"
    # equal grams lie together; what is used again is bound to a name, since an expression in a lambda is evaluated for each entry
    starts = "filter(sequence(0, size(g)), i -> i = size(g) OR i = 0 OR g[i] <> g[i - 1])"
    runs = "transform(slice(s, 1, size(s) - 1), (p, j) -> named_struct('k', g[p], 'n', s[j + 1] - p))"
    counted = f"IF(size(g) = 0, array(), flatten(transform(array({starts}), s -> {runs})))"
    return F.expr(f"flatten(transform(array({all_}), g -> {counted}))")


def pair_tfidf(a: str, b: str) -> Column:
    """Cosine of the n-gram weights of two gram columns, as fitted on just the two texts; 0 if one has none.

    Both sides are merged in the order of their grams, so that those of both texts lie together.
    """
    w2 = ONE_SIDED**2
    side = lambda x, i: f"transform({x}, e -> named_struct('k', e.k, 's', {i}, 'n', e.n))"
    merged = f"array_sort(concat({side(a, 0)}, {side(b, 1)}))"
    both = "filter(sequence(1, size(m) - 1), i -> m[i].k = m[i - 1].k)"
    step = "named_struct('d', t.d + m[i - 1].n * m[i].n, 'a', t.a + m[i - 1].n * m[i - 1].n, 'b', t.b + m[i].n * m[i].n)"
    shared = f"aggregate({both}, named_struct('d', 0, 'a', 0, 'b', 0), (t, i) -> {step})"
    squares = lambda x: f"aggregate({x}, 0, (t, e) -> t + e.n * e.n)"
    norm = lambda x, common: f"({w2}D * ({squares(x)} - {common}) + {common})"
    cosine = f"transform(array({shared}), c -> coalesce(try_divide(double(c.d), sqrt({norm(a, 'c.a')} * {norm(b, 'c.b')})), 0D))[0]"
    return F.expr(f"IF(size({a}) = 0 OR size({b}) = 0, 0D, transform(array({merged}), m -> {cosine})[0])")


def jaccard(a: str, b: str, both_empty: float = 0.5, one_empty: float = 0.3) -> Column:
    """Share of common entries of two arrays without repeats."""
    return F.expr(
        f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN {both_empty}D WHEN size({a}) = 0 OR size({b}) = 0 THEN {one_empty}D "
        f"ELSE size(array_intersect({a}, {b})) / double(size(array_union({a}, {b}))) END"
    )


def _codes(texts: list[str], known: np.ndarray, pad: int) -> np.ndarray:
    """One row for each text: the places of its characters in ``known``, and ``pad`` behind its end."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.searchsorted(known, np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32))
    out = np.full((len(texts), int(lengths.max(initial=0))), pad, np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def lcs_lengths(a: list[str], b: list[str], room: int = 1 << 22) -> np.ndarray:
    """Lengths of the longest common subsequences of all pairs at once, bit-parallel over 64-bit words.

    A bit of a pair's state stands for a character of its shorter text, and one step takes a character of the other text, in all
    pairs.  Pairs of about one length go together; ``room`` bounds the table of where each character stands.
    """
    n = len(a)
    out = np.zeros(n, np.int64)
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b)]
    sizes = np.fromiter(map(len, short), np.int64, n)
    order = np.lexsort((np.fromiter(map(len, long), np.int64, n), sizes))
    order = order[sizes[order] > 0]
    one, full = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    at = 0
    while at < len(order):
        some = order[at : at + 4096]
        known = np.unique(np.frombuffer("".join([short[i] for i in some] + [long[i] for i in some]).encode("utf-32-le", "surrogatepass"), np.uint32))
        words = -(-int(sizes[some].max()) // 64)
        some = some[: max(1, room // (words * (len(known) + 1)))]
        words = -(-int(sizes[some].max()) // 64)
        at += len(some)
        x, y = (_codes([t[i] for i in some], known, len(known)) for t in (short, long))
        rows = np.arange(len(some))
        where = np.zeros((words, len(known) + 1, len(some)), np.uint64)
        for i in range(x.shape[1]):
            where[i >> 6, x[:, i], rows] |= one << np.uint64(i & 63)
        where[:, -1] = 0  # nothing stands behind the end
        state = np.full((words, len(some)), full)
        for j in range(y.shape[1]):
            carry = np.zeros(len(some), np.uint64)
            for w in range(words):
                s = state[w]
                u = s & where[w, y[:, j], rows]
                t = s + u
                r = t + carry
                carry = ((t < s) | (r < t)).astype(np.uint64)
                state[w] = r | (s & ~u)
        for w in range(words):
            bits = np.clip(sizes[some] - 64 * w, 0, 64)
            inside = np.where(bits == 64, full, (one << (bits % 64).astype(np.uint64)) - one)
            out[some] += np.bitwise_count(~state[w] & inside)
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """1 less the share of insertions and deletions that lead from one text to the other, for all pairs; 1 if both are empty."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b)], float)
    return np.where(total > 0, 2 * lcs_lengths(a, b) / np.maximum(total, 1), 1.0)


def token_sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Ratios of the texts with their tokens in order."""
    in_order = {t: " ".join(sorted(t.split())) for t in {*a, *b}}
    return ratios([in_order[t] for t in a], [in_order[t] for t in b])


def token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """The best of comparing common tokens, and common tokens with either rest; 0 if a text has no token."""
    tokens = {t: set(t.split()) for t in {*a, *b}}
    out, open_, rests = np.zeros(len(a)), [], []
    for i, (s, t) in enumerate(zip(a, b)):
        x, y = tokens[s], tokens[t]
        if not x or not y:
            continue
        common, left, right = x & y, x - y, y - x
        if common and (not left or not right):
            out[i] = 1.0
            continue
        open_.append(i)
        rests.append((len(" ".join(common)), " ".join(sorted(left)), " ".join(sorted(right))))
    shared = lcs_lengths([left for _, left, _ in rests], [right for _, _, right in rests])
    for i, (n, left, right), same in zip(open_, rests, shared.tolist()):
        gap = 1 if n else 0
        na, nb = n + gap + len(left), n + gap + len(right)
        best = 1 - (len(left) + len(right) - 2 * same) / (na + nb)
        if n:
            best = max(best, 1 - (gap + len(left)) / (n + na), 1 - (gap + len(right)) / (n + nb))
        out[i] = best
    return out


def _distinct(a: pd.Series, b: pd.Series) -> tuple[list[str], list[str], np.ndarray]:
    """The distinct pairs of a batch, and which of them each row is; null is the empty text."""
    places: dict[tuple[str, str], int] = {}
    back = np.fromiter((places.setdefault((x or "", y or ""), len(places)) for x, y in zip(a, b)), np.int64, len(a))
    return [x for x, _ in places], [y for _, y in places], back


def token_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Mean of the token-set and token-sort ratios (0 to 1), for all pairs."""
    return (token_set_ratios(a, b) + token_sort_ratios(a, b)) / 2


@F.pandas_udf(DoubleType())
def token_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Mean of the token-set and token-sort ratios (0 to 1)."""
    x, y, back = _distinct(a, b)
    return pd.Series(token_ratios(x, y)[back])


@F.pandas_udf(DoubleType())
def sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The token-sort ratio (0 to 1) of texts as they are written."""
    x, y, back = _distinct(a, b)
    return pd.Series(token_sort_ratios(x, y)[back])


def gram_counts(text: str) -> dict[str, int]:
    """What ``grams`` counts, for one text."""
    out: dict[str, int] = {}
    for word in text.split():
        w = f" {word} "
        for n in (2, 3, 4):
            for i in range(len(w) - n + 1):
                k = w[i : i + n]
                out[k] = out.get(k, 0) + 1
    return out


def pair_cosines(a: list[str], b: list[str]) -> np.ndarray:
    """``pair_tfidf`` of all pairs of texts."""
    counted = {t: gram_counts(t) for t in {*a, *b}}
    squares = {t: sum(n * n for n in c.values()) for t, c in counted.items()}
    w2, out = ONE_SIDED**2, np.zeros(len(a))
    for i, (s, t) in enumerate(zip(a, b)):
        x, y = counted[s], counted[t]
        if x and y:
            both = [(x[k], y[k]) for k in x.keys() & y.keys()]
            xx, yy = sum(n * n for n, _ in both), sum(m * m for _, m in both)
            norm = math.sqrt((w2 * (squares[s] - xx) + xx) * (w2 * (squares[t] - yy) + yy))
            out[i] = sum(n * m for n, m in both) / norm
    return out


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("dense", "tfidf", "fuzzy")]))
def text_scores(a: pd.Series, b: pd.Series, u: pd.Series, v: pd.Series) -> pd.DataFrame:
    """All three similarities of a batch of pairs: of their vectors (null without one), of their n-grams, of their tokens."""
    x, y, back = _distinct(a, b)
    dense = np.full(len(u), np.nan)
    whole = np.flatnonzero((u.notna() & v.notna()).to_numpy())
    if len(whole):
        left, right = (np.stack(s.to_numpy()[whole]).astype(np.float64) for s in (u, v))
        dense[whole] = np.einsum("ij,ij->i", left, right)
    return pd.DataFrame({"dense": dense, "tfidf": pair_cosines(x, y)[back], "fuzzy": token_ratios(x, y)[back]})


def _word_grams(word: str) -> tuple[list[int], list[int]]:
    w, places, signs = f" {word} ", [], []
    for n in (2, 3, 4):
        for i in range(len(w) - n + 1):
            h = zlib.crc32(w[i : i + n].encode())
            places.append(h % DIM)
            signs.append(1 if h >> 31 else -1)
    return places, signs


def hashed_vector(text: str, known: dict | None = None) -> np.ndarray:
    """A signed count of hashed character n-grams, of length 1: stands in where no learned model is at hand.

    ``known`` keeps the n-grams of words from one text to the next.
    """
    known = {} if known is None else known
    if len(known) > 100_000:
        known.clear()
    places, signs = [], []
    for word in text.lower().split():
        got = known.get(word)
        if got is None:
            got = known[word] = _word_grams(word)
        places += got[0]
        signs += got[1]
    v = np.bincount(places, signs, DIM).astype(np.float32) if places else np.zeros(DIM, np.float32)
    norm = float(np.linalg.norm(v))
    return v / norm if norm else v


#: Makes an encoder in a worker, once: from texts to rows of unit length.
Encoder = Callable[[], Callable[[list[str]], np.ndarray]]


def hashed_encoder() -> Callable[[list[str]], np.ndarray]:
    known: dict = {}
    return lambda texts: np.stack([hashed_vector(t, known) for t in texts]) if texts else np.zeros((0, DIM), np.float32)


def encode(text: Column | str, encoder: Encoder = hashed_encoder, batch: int = 32) -> Column:
    """Dense vectors of a text column, in batches; another model can take the encoder's place."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for texts in parts:
            rows = [model([t or "" for t in texts[i : i + batch]]) for i in range(0, len(texts), batch)]
            yield pd.Series([v.tolist() for r in rows for v in r], dtype=object)

    return run(text)


def dense_similarity(dot: Column) -> Column:
    """A dot product of two vectors to four decimals, not below 0 nor above 1; null where there is none."""
    return F.when(dot.isNotNull() & ~F.isnan(dot), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.bround(dot, 4))))


def semantic(dense: Column, tfidf: Column, fuzzy: Column, empty: Column) -> Column:
    """0.5 dense, 0.25 n-grams, 0.25 tokens, to three decimals; 0 for empty texts, 0.5 where dense is missing."""
    mix = 0.50 * F.coalesce(dense, F.lit(0.5)) + 0.25 * F.coalesce(tfidf, fuzzy) + 0.25 * fuzzy
    return F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.bround(mix, 3))))

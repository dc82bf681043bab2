"""Convolutional text classifier in numpy.

Words (lower-cased, split at ASCII white space, edge punctuation off) are hashed by two functions into two small embedding
tables, so that two words share a vector only if both hashes collide.  Filters of several widths run over the word vectors,
a rectifier and max pooling over the whole text follow, then one logistic layer.  Thresholds are calibrated by language; the
language is told from the text's own function words, so that a score depends on nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import many_objects, single_threaded, texts_of, with_columns

#: Frequent function words that tell languages apart; "other" has none.
LANGUAGES = {
    "en": "the of and to is that it was for with this by from are be",
    "de": "der die und das ist nicht ein eine den zu mit sich auf dem für",
    "fr": "le les des est et une du dans que pour qui pas sur avec au",
    "es": "el los las del y una por con que se para como es su al",
}
EDGES = b".,;:!?*#$%&|<>\"'()[]{}-_"


@dataclass
class Settings:
    bits: int = 18  # of each table
    dim: int = 4  # of each table's vectors
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8  # of each width
    epochs: int = 5
    batch: int = 64
    min_texts: int = 5  # that a word's bucket must stand in
    rate: float = 0.05
    seed: int = 7
    max_rows_per_class: int = 4000  # bounds of the labelled sample
    max_bytes: int = 96 << 20


class WordHasher:
    """Two bucket numbers and a language number for each word; 0 is kept for padding."""

    def __init__(self, bits: int, keep: int = 400_000):
        self.size, self.keep, self.known = (1 << bits) - 1, keep, {}
        self.language: dict[bytes, int] = {}
        seen: dict[str, list[int]] = {}
        for i, words in enumerate(LANGUAGES.values(), 1):
            for w in words.split():
                seen.setdefault(w, []).append(i)
        self.language = {w.encode(): at[0] for w, at in seen.items() if len(at) == 1}

    def __call__(self, texts: Iterable[str], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all words with ``pad`` zeros after each text, each text's start, and each text's language."""
        split = [t.lower().encode("utf-8", "surrogatepass").split() for t in texts]
        if len(self.known) > self.keep:
            self.known.clear()
        for w in set().union(*split).difference(self.known):
            core = w.strip(EDGES) or w
            h = xxh3_64_intdigest(core)
            self.known[w] = ((h >> 32) % self.size + 1) << 32 | ((h & 0xFFFFFFFF) % self.size + 1) << 4 | self.language.get(core, 0)
        get, flat, starts = self.known.__getitem__, [], []
        for words in split:
            starts.append(len(flat))
            flat += map(get, words)
            flat += [0] * pad
        codes, starts = np.array(flat, np.int64), np.array(starts, np.int64)
        told = np.flatnonzero(codes & 15)
        doc, kinds = np.searchsorted(starts, told, "right") - 1, len(LANGUAGES) + 1
        counts = np.bincount(doc * kinds + (codes[told] & 15), minlength=len(starts) * kinds).reshape(-1, kinds)
        return codes, starts, counts.argmax(1)  # 0 where there is none


class Net:
    def __init__(self, s: Settings):
        r = np.random.default_rng(s.seed)
        self.s, self.shift = s, np.zeros(len(LANGUAGES) + 1)
        f = np.float32
        self.e = [r.normal(0, 0.1, ((1 << s.bits), s.dim)).astype(f) for _ in range(2)]
        self.live = [np.ones(1 << s.bits, bool) for _ in range(2)]  # buckets that may learn
        d, n = 2 * s.dim, s.filters
        self.w = [r.normal(0, 1 / np.sqrt(d * k), (k * d, n)).astype(f) for k in s.widths]
        self.b = [np.zeros(n, f) for _ in s.widths]
        self.v, self.c = r.normal(0, 0.3, n * len(s.widths)).astype(f), np.zeros(1, f)

    def hashed(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return codes >> 32, codes >> 4 & 0xFFFFFFF

    def forward(self, codes: np.ndarray, starts: np.ndarray, winners: bool = False):
        """Logits of the texts; with ``winners`` also what training needs."""
        s, (h1, h2) = self.s, self.hashed(codes)
        x = np.concatenate([self.e[0][h1], self.e[1][h2]], 1)
        d, n = x.shape[1], s.filters
        y = np.concatenate([w[:d] for w in self.w], 1).T @ x.T  # filters x positions
        for j in range(1, max(s.widths)):
            for i, (k, w) in enumerate(zip(s.widths, self.w)):
                if j < k:
                    y[i * n : (i + 1) * n, : len(x) - j] += w[j * d : (j + 1) * d].T @ x.T[:, j:]
        won, ends = [], np.append(starts[1:], len(codes))
        for i, k in enumerate(s.widths):  # windows that would reach into the next text do not count
            for j in range(1, k):
                y[i * n : (i + 1) * n, ends - j] = -np.inf
        if winners:
            at = np.stack([y[:, lo:hi].argmax(1) + lo for lo, hi in zip(starts, ends)])  # texts x filters
            top = y[np.arange(len(y)), at]
            won = [at[:, i * n : (i + 1) * n] for i in range(len(s.widths))]
        else:
            top = np.maximum.reduceat(y, starts, axis=1).T
        p = np.maximum(top + np.concatenate(self.b), 0)
        z = p @ self.v + self.c[0]
        return (z, p, won, x, (h1, h2)) if winners else z

    def step(self, codes: np.ndarray, starts: np.ndarray, y: np.ndarray, memory: dict) -> float:
        """One AdaGrad step on log loss; only the pooled windows carry a gradient."""
        s = self.s
        z, p, won, x, (h1, h2) = self.forward(codes, starts, winners=True)
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = ((q - y) / len(y)).astype(np.float32)
        n, d = s.filters, x.shape[1]
        gp = g[:, None] * self.v * (p > 0)
        self._adagrad("v", self.v, p.T @ g + 1e-4 * self.v, memory)
        self._adagrad("c", self.c, np.array([g.sum()], np.float32), memory)
        gx_at, gx = [], []
        for i, k in enumerate(s.widths):
            part, first = gp[:, i * n : (i + 1) * n], won[i]
            gw = np.zeros_like(self.w[i])
            for j in range(k):
                at = np.minimum(first + j, len(codes) - 1)
                rows = x[at]  # texts x filters x d
                gw[j * d : (j + 1) * d] = np.einsum("tf,tfd->df", part, rows)
                wj = self.w[i][j * d : (j + 1) * d]  # d x filters
                gx_at.append(at.ravel())
                gx.append((part[:, :, None] * wj.T[None]).reshape(-1, d))
            self._adagrad(f"w{i}", self.w[i], gw, memory)
            self._adagrad(f"b{i}", self.b[i], part.sum(0), memory)
        at, gx = np.concatenate(gx_at), np.concatenate(gx)
        live = np.abs(gx).sum(1) > 0
        at, gx = at[live], gx[live]
        for t, h in enumerate((h1, h2)):
            rows = h[at]
            ok = self.live[t][rows]
            u, inv = np.unique(rows[ok], return_inverse=True)
            if len(u):
                grad = np.zeros((len(u), s.dim), np.float32)
                np.add.at(grad, inv, gx[ok, t * s.dim : (t + 1) * s.dim])
                m = memory.setdefault(f"e{t}", np.zeros_like(self.e[t]))
                m[u] += grad**2
                self.e[t][u] -= s.rate * grad / np.sqrt(m[u] + 1e-10)
        return float(-np.mean(np.log(np.where(y > 0, q, 1 - q) + 1e-9)))

    def _adagrad(self, key: str, w: np.ndarray, g: np.ndarray, memory: dict) -> None:
        m = memory.setdefault(key, np.zeros_like(w))
        m += g**2
        w -= self.s.rate * g / np.sqrt(m + 1e-10)

    def score(self, codes: np.ndarray, starts: np.ndarray, lang: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        z = self.forward(codes, starts).astype(float) - self.shift[lang]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(texts: list[str], labels: list[int], settings: Settings = Settings()) -> Net:
    """A classifier with thresholds by language.  A fifth of the rows is kept from training to set the thresholds."""
    single_threaded()
    net, hasher, rng = Net(settings), WordHasher(settings.bits, 4_000_000), np.random.default_rng(settings.seed)
    if not texts:
        net.c[0] = -4
        return net
    y = np.array(labels, np.float32)
    order = rng.permutation(len(texts))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    pad = max(settings.widths) - 1
    coded = [hasher([t], pad) for t in texts]
    memory: dict = {}
    for t in range(2):  # words too rare to learn from have no vector
        seen = np.zeros(1 << settings.bits, np.int32)
        for i in fit:
            seen[np.unique(net.hashed(coded[i][0])[t])] += 1
        net.live[t] = seen >= settings.min_texts
        net.live[t][0] = False
        net.e[t][~net.live[t]] = 0

    def joined(rows):
        sizes = np.array([len(coded[i][0]) for i in rows])
        return np.concatenate([coded[i][0] for i in rows]), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), np.concatenate([coded[i][2] for i in rows])

    for _ in range(settings.epochs):
        # texts of like length share a batch: the order is random but for that
        mixed = fit[np.argsort(np.array([len(coded[i][0]) for i in fit]) * np.exp(rng.normal(0, 0.5, len(fit))))]
        parts = [mixed[i : i + settings.batch] for i in range(0, len(mixed), settings.batch)]
        for i in rng.permutation(len(parts)):
            codes, starts, _ = joined(parts[i])
            net.step(codes, starts, y[parts[i]], memory)
    if len(held):
        z, lang = np.zeros(len(held)), np.zeros(len(held), int)
        for lo in range(0, len(held), 256):
            codes, starts, l = joined(held[lo : lo + 256])
            z[lo : lo + 256], lang[lo : lo + 256] = net.forward(codes, starts), l
        overall = best_threshold(z, y[held])
        net.shift[:] = overall
        for i in range(len(net.shift)):
            own = lang == i
            if min((y[held][own] > 0).sum(), (y[held][own] == 0).sum()) >= 20:
                net.shift[i] = best_threshold(z[own], y[held][own])
    return net


def best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The logit with the fewest errors; between two neighbours, nearest 0 where several do."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y > 0)]) + np.concatenate([np.cumsum((y == 0)[::-1])[::-1], [0]])
    cuts = np.concatenate([[z[0] - 2], (z[1:] + z[:-1]) / 2, [z[-1] + 2]])
    best = np.flatnonzero(errors == errors.min())
    lo, hi = cuts[best[0]], cuts[best[-1]]
    if len(best) == 1 and 0 < best[0] < len(z):  # a gap between the classes: 0 if it lies inside
        lo, hi = z[best[0] - 1], z[best[0]]
        if lo < 0 <= hi:
            return 0.0
        return float((lo + hi) / 2)
    return float(min(max(0.0, lo), hi))


def labelled_sample(docs: DataFrame, labels: DataFrame, usable, label: str, settings, doc_id: str = "doc_id", text: str = "text"):
    """Labelled texts, at most ``max_rows_per_class`` ids of each class and ``max_bytes`` in all, chosen by hashes.

    A text, or a share of the texts, that the bytes have no room for is passed over, and the others stay.  An id with several texts, or with both labels, gives a row for each; equal rows count once.  Null ids are left out.
    """
    rows = labels.filter(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).filter(usable("_id")).distinct()
    # a share of each class by hash, so that no task or driver holds more than the bound
    sizes = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    top, some = 1 << 30, settings.max_rows_per_class
    chosen = rows.filter("false")
    for y, n in sizes.items():
        share = top if n <= some else int(top * 0.9 * some / n)
        chosen = chosen.unionByName(rows.filter((F.col("_y") == y) & (F.pmod(F.xxhash64("_id"), F.lit(top)) < share)).limit(some))
    # ids and labels only, a bounded number of them, are broadcast
    found = docs.select(docs[doc_id].alias("_id"), F.coalesce(docs[text], F.lit("")).alias("_t")).join(F.broadcast(chosen), "_id")
    # repeated ids and long texts have no bound of their own: shares of the rows, by hash, those that the bytes have room for
    found = found.withColumn("_b", F.octet_length("_t")).filter(F.col("_b") <= settings.max_bytes).withColumn("_h", F.pmod(F.xxhash64("_id", "_t"), F.lit(1024)).cast("int"))
    held, fit = 0, []
    for r in sorted(found.groupBy("_h").agg(F.sum("_b").alias("n")).collect()):
        if held + r["n"] <= settings.max_bytes:
            held += r["n"]
            fit.append(r["_h"])
    found = list({(r["_id"], r["_t"], r["_y"]): r for r in found.filter(F.col("_h").isin(fit)).drop("_h", "_b").collect()}.values())
    found.sort(key=lambda r: (r["_id"], r["_t"] or "", r["_y"]))
    return [r["_t"] or "" for r in found], [r["_y"] for r in found]


def score_texts(docs: DataFrame, net: Net, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column ``score`` (0 to 1; at least 0.5: rejected).  Null and empty texts get the score of no words."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size, set by Settings
    pad = max(net.s.widths) - 1

    def make():
        single_threaded()
        many_objects()
        own, hasher = shipped.value, WordHasher(net_bits)

        def work(batch: pa.RecordBatch) -> dict:
            return {score: own.score(*hasher(texts_of(batch, text), pad))}

        return work

    net_bits = net.s.bits
    return with_columns(docs, f"`{score}` double", make, rows=128)

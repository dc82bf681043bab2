"""Log-bilinear language model, trained with noise-contrastive estimation in numpy.

Symbols are the most frequent words and, for all other words, classes by their last two bytes.  The model predicts a symbol
from the two before it: the context vector ``r[c1] * m1 + r[c2] * m2`` meets each symbol's vector.  A word of a class then has
its smoothed share of the class, so that the probabilities of all words sum to one.

Every training token is used.  Counts are exact sums over the corpus.  The weights are trained by parameter mixing: each
partition runs stochastic steps over its own tokens, their weights are averaged in a tree, and the next part of the corpus
starts from the mean.  For scoring, two matrix products of exponentials give the normaliser of every context at once.

Frequent words (a fixed number) are looked up in the workers.  The rest meet their counts in a join on the word.  Words of the
training rows in it are rare by definition; a word that stands in held-out rows only may be frequent, and its rows are then one
side of a left join that Spark's adaptive execution splits.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import many_objects, single_threaded, texts_of, with_columns, written

END = b""  # the token after the last word of a text; no word is empty


@dataclass
class Settings:
    core: int = 1920  # words that are symbols: with the classes, tables of 2048 x 2048
    classes: int = 128
    dim: int = 16
    lookup: int = 131_072  # words whose counts every worker holds
    noise: int = 64
    batch: int = 1024
    rate: float = 0.1
    rounds: int = 2
    seed: int = 3


@dataclass
class Model:
    s: Settings
    core: dict[bytes, int] = field(default_factory=dict)
    unigram: np.ndarray | None = None  # of symbols
    r: np.ndarray | None = None
    q: np.ndarray | None = None
    b: np.ndarray | None = None
    m: np.ndarray | None = None

    @property
    def symbols(self) -> int:
        return self.s.core + self.s.classes

    @property
    def start(self) -> int:  # the context before the first word
        return self.symbols

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.b, self.m)]).astype(np.float32)

    def load(self, x: np.ndarray) -> Model:
        n, d = self.symbols, self.s.dim
        cuts = np.cumsum([(n + 1) * d, n * d, n])
        r, q, b, m = np.split(x.astype(np.float32), cuts)
        self.r, self.q, self.b, self.m = r.reshape(n + 1, d), q.reshape(n, d), b, m.reshape(2, d)
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits by nearer and by farther context, and the log normaliser of each pair of contexts."""
        r, q = self.r.astype(float), self.q.astype(float)
        near, far = (r * self.m[0]) @ q.T + self.b, (r * self.m[1]) @ q.T
        top1, top2 = near.max(1, keepdims=True), far.max(1, keepdims=True)
        z = np.log(np.maximum(np.exp(near - top1) @ np.exp(far - top2).T, 1e-300)) + top1 + top2.T
        return near.astype(np.float32), far.astype(np.float32), z.astype(np.float32)


def words_of(text: str) -> list[bytes]:
    """Words with A-Z lowered, and the end token."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def suffix_class(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-2:]) % classes


def suffix_class_column(word, classes: int):
    return F.crc32(F.expr("substring(w, -2, 2)")) % classes


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """``w`` (binary), ``c`` over all rows.  Each task counts before the shuffle and holds a bounded number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many_objects()
        own: Counter = Counter()

        def out():
            items = list(own.items())
            for at in range(0, len(items), 50_000):
                w, c = zip(*items[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(c, pa.int64())], names=["w", "c"])
            own.clear()

        for b in batches:
            for t in texts_of(b, "t"):
                own.update(words_of(t))
                if len(own) > 300_000:
                    yield from out()
        yield from out()

    return docs.select(docs[text].alias("t")).mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


class Symbols:
    """Symbol numbers of words."""

    def __init__(self, model: Model):
        self.core, first, k = model.core, model.s.core, model.s.classes

        class Suffixes(dict):
            def __missing__(self, s):
                self[s] = v = first + zlib.crc32(s) % k
                return v

        self.suffix = Suffixes()

    def __call__(self, words: list[bytes]) -> list[int]:
        core, suffix = self.core.get, self.suffix
        return [x if (x := core(w)) is not None else suffix[w[-2:]] for w in words]


def contexts(ids: np.ndarray, starts: np.ndarray, start_symbol: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two places before each."""
    near, far = np.empty_like(ids), np.empty_like(ids)
    near[1:], far[2:] = ids[:-1], ids[:-2]
    near[starts] = far[starts] = start_symbol
    second = starts + 1
    far[second[second < len(ids)]] = start_symbol
    return near, far


def _scatter(grad: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at.astype(np.uint16), kind="stable")
    k = at[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    grad[k[first]] += np.add.reduceat(rows[order], first, axis=0)


class Trainer:
    def __init__(self, model: Model, seed: int):
        self.p, self.rng = model, np.random.default_rng(seed)
        self.cdf = np.cumsum(model.unigram)
        self.logk = np.log(model.s.noise * model.unigram + 1e-12).astype(np.float32)
        self.memory = [np.full_like(x, 1e-4) for x in (model.r, model.q, model.b, model.m)]

    def step(self, near: np.ndarray, far: np.ndarray, w: np.ndarray) -> None:
        """One AdaGrad step; the noise words are shared by the batch."""
        p, n = self.p, len(w)
        noise = np.minimum(np.searchsorted(self.cdf, self.rng.random(p.s.noise) * self.cdf[-1]), p.symbols - 1)
        r1, r2, qw, qn = p.r[near], p.r[far], p.q[w], p.q[noise]
        h = r1 * p.m[0] + r2 * p.m[1]
        clip = lambda x: np.clip(x, -30, 30)
        gd = 1 / (1 + np.exp(clip(np.einsum("ij,ij->i", h, qw) + p.b[w] - self.logk[w])))
        gn = -1 / (1 + np.exp(-clip(h @ qn.T + (p.b - self.logk)[noise])))
        gh = gd[:, None] * qw + gn @ qn
        g = [np.zeros_like(x) for x in (p.r, p.q, p.b, p.m)]
        _scatter(g[0], near, gh * p.m[0])
        _scatter(g[0], far, gh * p.m[1])
        _scatter(g[1], w, gd[:, None] * h)
        np.add.at(g[1], noise, gn.T @ h)
        g[2] += np.bincount(w, gd, p.symbols).astype(np.float32)
        np.add.at(g[2], noise, gn.sum(0))
        g[3][0], g[3][1] = np.einsum("ij,ij->j", gh, r1), np.einsum("ij,ij->j", gh, r2)
        for x, gx, mem in zip((p.r, p.q, p.b, p.m), g, self.memory):
            gx /= n
            mem += gx * gx
            x += p.s.rate * gx / np.sqrt(mem)


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of all weights by number of tokens, as one row."""
    total, sum_ = 0, None
    for b in batches:
        for x, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            v = np.frombuffer(x, np.float32) * np.float64(n)
            sum_, total = v if sum_ is None else sum_ + v, total + n
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([(sum_ / total).astype(np.float32).tobytes()], pa.binary()), pa.array([total], pa.int64())], names=["x", "n"])


def mix_round(docs: DataFrame, model: Model, text: str, seed: int) -> Model:
    """One pass of local training in every partition, then the mean; at most 32 weight vectors meet in a task."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        own = Model(**{**vars(shipped.value)}).load(shipped.value.flat())
        symbols, trainer, size, tokens = Symbols(own), Trainer(own, seed), own.s.batch, 0
        near, far, ids = (np.empty(0, np.int64) for _ in range(3))
        for big in batches:
            for at in range(0, big.num_rows, 64):
                words = [words_of(t) for t in texts_of(big.slice(at, 64), "t")]
                new = np.array([i for w in words for i in symbols(w)], np.int64)
                starts = np.cumsum([0] + [len(w) for w in words[:-1]])
                n1, n2 = contexts(new, starts, own.start)
                ids, near, far = np.concatenate([ids, new]), np.concatenate([near, n1]), np.concatenate([far, n2])
                done = len(ids) // size * size
                order = trainer.rng.permutation(done)
                for lo in range(0, done, size):
                    k = order[lo : lo + size]
                    trainer.step(near[k], far[k], ids[k])
                tokens += len(new)
                ids, near, far = ids[done:], near[done:], far[done:]
        if len(ids):
            trainer.step(near, far, ids)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([own.flat().tobytes()], pa.binary()), pa.array([tokens], pa.int64())], names=["x", "n"])

    df = docs.select(docs[text].alias("t")).mapInArrow(run, "x binary, n long")
    parts = docs.rdd.getNumPartitions() if docs.columns else 1
    while parts > 1:
        parts = -(-parts // 32)
        df = df.repartition(parts).mapInArrow(_mean, "x binary, n long")
    got = df.collect()  # one row
    return model.load(np.frombuffer(got[0]["x"], np.float32)) if got else model


@dataclass
class Trained:
    model: Model
    counts: DataFrame  # w, c: every training word
    tokens: int
    distinct: int
    lookup: dict[bytes, int]  # frequent words' counts
    class_tokens: np.ndarray
    class_distinct: np.ndarray


def train(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> Trained:
    """Counts and weights from all rows of ``docs``.  Without rows, an untrained model with zero counts."""
    s, counts = settings, written(count_words(docs, text), "word-counts")
    by_class = counts.groupBy(suffix_class_column("w", s.classes).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    in_class = np.zeros((2, s.classes), np.int64)
    for row in by_class:
        in_class[:, row["k"]] = row["n"], row["v"]
    n, v = int(in_class[0].sum()), int(in_class[1].sum())
    # the most frequent words by steps of the logarithm of their counts: a few hundred sizes tell how far the bound reaches
    step = F.floor(F.log2("c") * 16).cast("int")
    room, least = s.lookup, 1 << 30
    for row in sorted(counts.groupBy(step.alias("k")).count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least = row["k"]
    rows = counts.filter((step >= least) | (F.length("w") == 0)).collect()  # the end token always
    frequent = sorted(((bytes(r["w"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))
    core_words = [END] + [w for w, _ in frequent[: s.core] if w != END][: s.core - 1]
    lookup, model = dict(frequent), Model(s, {w: i for i, w in enumerate(core_words)})
    core_counts = np.zeros(s.core)
    for w, i in model.core.items():
        core_counts[i] = c = lookup.get(w, 0)
        if c:
            in_class[:, suffix_class(w, s.classes)] -= (c, 1)
    weights = np.concatenate([core_counts, in_class[0]]) + 0.1
    weights[len(core_words) : s.core] = 1e-9  # symbols without a word
    model.unigram = weights / weights.sum()
    rng, d = np.random.default_rng(s.seed), s.dim
    model.r, model.q = (rng.normal(0, 0.1, (k, d)).astype(np.float32) for k in (model.symbols + 1, model.symbols))
    model.b, model.m = np.log(model.unigram).astype(np.float32), np.stack([np.ones(d), np.full(d, 0.7)]).astype(np.float32)
    if n:
        for i in range(s.rounds):
            part = docs.filter(F.pmod(F.xxhash64(F.col(text)), F.lit(s.rounds)) == i)
            model = mix_round(part, model, text, s.seed + i)
    return Trained(model, counts, n, v, lookup, in_class[0], in_class[1])


ADDED = "_tokens long, _known long, _base double, _score double, _rare array<binary>"


def score_texts(docs: DataFrame, t: Trained, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens, n_known, train_tokens, base_score, score`` (log10; null and empty texts: the end token alone).

    Repeated rows are scored apart.  Columns of the same names are replaced.
    """
    s, sc = t.model.s, docs.sparkSession.sparkContext
    outer = t.model.symbols - s.classes
    log_class = np.log10(t.class_tokens + 0.1 * (t.class_distinct + 1))
    words = list(t.lookup)
    counts = np.array([t.lookup[w] for w in words], float)
    core = [t.model.core.get(w) for w in words]
    symbol = np.array([outer + suffix_class(w, s.classes) if i is None else i for w, i in zip(words, core)], np.int64)
    log_c = np.log10(counts + 0.1)
    within = np.array([0.0 if i is not None else log_c[k] - log_class[symbol[k] - outer] for k, i in enumerate(core)])
    shipped = sc.broadcast((words, symbol, log_c, within, log_class, t.model.tables(), s, t.model.core[END]))  # bounded by Settings
    log_all = float(np.log10(t.tokens + 0.1 * (t.distinct + 1)))
    start = t.model.start

    def make():
        single_threaded()
        many_objects()
        words, symbol, log_c, within, log_class, (near_t, far_t, z), s, end = shipped.value
        n, rare = len(words), []

        class Code(dict):
            """Place in the lookup; other words are noted and get a place after it, by class."""

            def __missing__(self, w):
                if w == END:
                    return n + s.classes
                rare.append(w)
                return n + zlib.crc32(w[-2:]) % s.classes

        code = Code(zip(words, range(n)))
        symbol = np.concatenate([symbol, s.core + np.arange(s.classes), [end]])
        log_c = np.concatenate([log_c, np.zeros(s.classes), [-1.0]])
        within = np.concatenate([within, -log_class, [0.0]])

        def work(batch: pa.RecordBatch) -> dict:
            flat, starts, kept = [], [], []
            for t in texts_of(batch, text):
                starts.append(len(flat))
                flat += map(code.__getitem__, words_of(t))
                kept.append(rare[:])
                rare.clear()
            starts, at = np.array(starts, np.int64), np.array(flat, np.int64)
            ids = symbol[at]
            near, far = contexts(ids, starts, start)
            lp = (near_t[near, ids].astype(float) + far_t[far, ids] - z[near, far]) / np.log(10) + within[at]
            sizes = np.diff(np.append(starts, len(at)))
            return {"_tokens": sizes, "_known": np.add.reduceat((at < n).astype(np.int64), starts), "_base": np.add.reduceat(log_c[at], starts), "_score": np.add.reduceat(lp, starts), "_rare": kept}

        return work

    kept = [c for c in docs.columns if c.lower() not in {"n_tokens", "n_known", "train_tokens", "base_score", "score", text.lower()}]
    first = written(with_columns(docs.select(*kept, text), ADDED, make, rows=128).drop(text).withColumn("_row", F.monotonically_increasing_id()), "scored")
    pairs = first.select("_row", F.explode("_rare").alias("w"))
    found = pairs.join(t.counts, "w", "left").groupBy("_row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("_r"), F.count("c").alias("_k"))
    out = first.join(found, "_row", "left")
    r, k = F.coalesce("_r", F.lit(0.0)), F.coalesce("_k", F.lit(0))
    return out.select(
        *kept,
        F.col("_tokens").alias("n_tokens"),
        (F.col("_known") + k).alias("n_known"),
        F.lit(t.tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + r - F.col("_tokens") * log_all).alias("base_score"),
        (F.col("_score") + r).alias("score"),
    )

"""Content or boilerplate, line by line: a linear-chain conditional random field over the lines of a text.

Each line has bucketed features; the field's weights are trained in numpy by AdaGrad on the likelihood of weakly labelled
lines (a text's quality label, but a repeated line is boilerplate).  Viterbi decoding labels the lines of whole texts; a text
stays if enough of its word characters stand in content lines.  Plain rules on words and repetition come first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACES, many_objects, single_threaded, texts_of, with_columns

SYMBOLS = "#*$%&|<>"
_UPPER, _LOWER, _DIGIT = (bytes(range(a, b)) for a, b in ((65, 91), (97, 123), (48, 58)))
_MARKS, _BLANK = b"#*$%&|<>!=_~^@{}[]\\/", SPACES.encode()
#: Upper bounds of the buckets of each feature.
BUCKETS = {
    "words": (0, 1, 2, 4, 8, 16, 32, 64),
    "marks": (0.0, 0.02, 0.05, 0.1, 0.2, 0.4),
    "upper": (0.0, 0.05, 0.15, 0.4, 0.8),
    "digits": (0.0, 0.05, 0.15, 0.4),
    "distinct": (0.2, 0.5, 0.8, 0.99),
    "length": (2.0, 3.5, 5.0, 7.0, 10.0),
    "pipes": (0, 2),
    "repeated": (0,),
    "shouted": (0,),
}
WIDTHS = [len(b) + 1 for b in BUCKETS.values()]
OFFSETS = np.concatenate([[0], np.cumsum(WIDTHS)[:-1]])


@dataclass
class Settings:
    max_rows_per_class: int = 1500  # bounds of the labelled sample
    max_bytes: int = 64 << 20
    epochs: int = 8
    rate: float = 0.3
    share: float = 0.5  # of word characters in content lines, to stay
    min_words: int = 10
    max_repeat_percent: int = 20
    seed: int = 5


def line_features(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Raw features of each line, its word characters, and how many lines with a word equal an earlier one."""
    rows, sizes, seen, dup = [], [], set(), 0
    for line in text.split("\n"):
        b = line.encode("utf-8", "surrogatepass")
        solid = b.translate(None, _BLANK)
        n = len(solid)
        if not n:
            rows.append((0, 0, 0, 0, 1, 0, 0, 0, 0))
            sizes.append(0)
            continue
        repeated = line in seen
        seen.add(line)
        dup += repeated
        words = b.split()
        upper, lower = n - len(solid.translate(None, _UPPER)), n - len(solid.translate(None, _LOWER))
        rows.append((len(words), (n - len(solid.translate(None, _MARKS))) / n, upper / max(1, upper + lower), (n - len(solid.translate(None, _DIGIT))) / n, len(set(words)) / len(words), n / len(words), solid.count(b"|"), repeated, solid.endswith(b"!!")))
        sizes.append(len(line) - sum(map(line.count, SPACES)))
    return np.array(rows, np.float64), np.array(sizes, np.int64), dup


def coded(rows: np.ndarray) -> np.ndarray:
    """Index of each feature's weight."""
    return np.stack([np.searchsorted(b, rows[:, i], "left") for i, b in enumerate(BUCKETS.values())], 1) + OFFSETS


class Field:
    """Label 1 is content.  ``w``: weight of each feature for label 1 over 0; ``move[a, b]``: from label a to b."""

    def __init__(self):
        self.w, self.move, self.first = np.zeros(sum(WIDTHS)), np.zeros((2, 2)), np.zeros(2)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return self.w[codes].sum(1)

    def marginals(self, e: np.ndarray, live: np.ndarray):
        """Of padded texts (texts x lines): P(label 1) by line and the expected moves."""
        n, t = e.shape
        emit = np.stack([np.zeros_like(e), e], 2)
        up, down = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        up[:, 0] = self.first + emit[:, 0]
        for i in range(1, t):
            x = up[:, i - 1, :, None] + self.move
            up[:, i] = np.where(live[:, i, None], np.logaddexp(x[:, 0], x[:, 1]) + emit[:, i], up[:, i - 1])
        for i in range(t - 2, -1, -1):
            x = self.move + (emit[:, i + 1] + down[:, i + 1])[:, None, :]
            down[:, i] = np.where(live[:, i + 1, None], np.logaddexp(x[..., 0], x[..., 1]), 0)
        whole = np.logaddexp(up[:, -1, 0], up[:, -1, 1])
        p = np.exp(up + down - whole[:, None, None])
        moves = np.zeros((2, 2))
        if t > 1:
            x = up[:, :-1, :, None] + self.move + (emit[:, 1:] + down[:, 1:])[:, :, None, :] - whole[:, None, None, None]
            moves = (np.exp(np.minimum(x, 0)) * live[:, 1:, None, None]).sum((0, 1))
        return p[..., 1], moves, p[:, 0].sum(0)

    def viterbi(self, e: np.ndarray, live: np.ndarray) -> np.ndarray:
        """The best labels of padded texts."""
        n, t = e.shape
        back = np.zeros((n, t, 2), np.int8)
        best = np.stack([np.full(n, self.first[0]), self.first[1] + e[:, 0]], 1)
        for i in range(1, t):
            x = best[:, :, None] + self.move
            arg = x[:, 1] > x[:, 0]
            new = np.where(arg, x[:, 1], x[:, 0])
            new[:, 1] += e[:, i]
            on = live[:, i, None]
            back[:, i] = np.where(on, arg, [0, 1])
            best = np.where(on, new, best)
        out, at = np.zeros((n, t), np.int8), (best[:, 1] >= best[:, 0]).astype(np.int8)
        rows = np.arange(n)
        for i in range(t - 1, -1, -1):
            out[:, i] = at
            at = back[rows, i, at]
        return out


def padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, parts))
    e, live = np.zeros((len(parts), t)), np.zeros((len(parts), t), bool)
    for i, p in enumerate(parts):
        e[i, : len(p)], live[i, : len(p)] = p, True
    return e, live


def by_length(sizes: list[int], most: int = 60_000):
    """Groups of texts of like length, so that padding stays small."""
    order, group = sorted(range(len(sizes)), key=sizes.__getitem__), []
    for i in order:
        if group and (len(group) + 1) * sizes[i] > min(most, 2 * len(group) * sizes[group[0]] + 4000):
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def train(texts: list[str], labels: list[int], settings: Settings = Settings()) -> Field:
    """A field trained on lines labelled by their text's quality; without texts, one that calls all lines content."""
    field, rng = Field(), np.random.default_rng(settings.seed)
    field.first[1] = 1e-6
    if not texts:
        return field
    codes, gold = [], []
    for text, y in zip(texts, labels):
        rows, _, _ = line_features(text)
        codes.append(coded(rows))
        gold.append((y * (1 - rows[:, 7])).astype(np.int64))
    memory = {k: np.full_like(getattr(field, k), 1e-8) for k in ("w", "move", "first")}
    groups = [g[i : i + 96] for g in by_length([len(c) for c in codes]) for i in range(0, len(g), 96)]
    for _ in range(settings.epochs):
        for k in rng.permutation(len(groups)):
            g = groups[k]
            e, live = padded([field.scores(codes[i]) for i in g])
            p, moves, first = field.marginals(e, live)
            lines = sum(len(codes[i]) for i in g)
            grad = {"w": np.zeros_like(field.w), "move": -moves, "first": -first}
            for row, i in enumerate(g):
                y = gold[i]
                np.add.at(grad["w"], codes[i], np.broadcast_to((y - p[row, : len(y)])[:, None], codes[i].shape))
                np.add.at(grad["move"], (y[:-1], y[1:]), 1)
                grad["first"][y[0]] += 1
            for name, x in grad.items():
                own = getattr(field, name)
                x = x / lines - 1e-4 * own
                memory[name] += x**2
                own += settings.rate * x / np.sqrt(memory[name])
    return field


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """Of each text, the words that stand in a window of five found twice or more in it."""
    sizes = np.array([len(w) for w in words], np.int64)
    total, out = int(sizes.sum()), np.zeros(len(words), np.int64)
    if total < 5:
        return out
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.uint64, total)
    doc = np.repeat(np.arange(len(words)), sizes)
    with np.errstate(over="ignore"):
        h = ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        key = doc[:-4].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        for j in range(5):
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + h[j : total - 4 + j]
    at = np.flatnonzero(doc[:-4] == doc[4:])
    if not len(at):
        return out
    order = at[np.argsort(key[at], kind="stable")]
    k = key[order]
    twin = np.zeros(len(k), bool)
    twin[1:] = k[1:] == k[:-1]
    twin[:-1] |= twin[1:]
    hit = np.zeros(total + 5, np.int32)
    np.add.at(hit, order[twin], 1)
    np.add.at(hit, order[twin] + 5, -1)
    covered = np.cumsum(hit)[:total] > 0
    return np.bincount(doc[covered], minlength=len(words)).astype(np.int64)


ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean"


def judge_texts(docs: DataFrame, field: Field, settings: Settings = Settings(), text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the columns of ``ADDED``, their names after ``prefix``.

    Null and empty texts have no words and are not kept.  ``content_share`` is 0 where there are no words.  Rows are judged
    one by one, so repeated rows and ids are no special case; columns of the same names are replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(field)  # a few hundred numbers

    def make():
        single_threaded()
        many_objects()
        own = shipped.value

        def work(batch: pa.RecordBatch) -> dict:
            texts = texts_of(batch, text)
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
            made = [line_features(t) for t in texts]
            sizes = [m[1] for m in made]
            raw = np.concatenate([m[0] for m in made])
            ends = np.cumsum([len(s) for s in sizes])
            emit = np.split(own.scores(coded(raw)), ends[:-1])
            content = np.zeros(len(texts))
            for group in by_length([len(s) for s in sizes]):
                labels = own.viterbi(*padded([emit[i] for i in group]))
                for row, i in enumerate(group):
                    content[i] = sizes[i] @ labels[row, : len(sizes[i])]
            n, chars, again = np.array([len(w) for w in words]), np.array([int(s.sum()) for s in sizes]), repeated_words(words)
            share = content / np.maximum(chars, 1)
            failed = (n < settings.min_words) | (100 * again > settings.max_repeat_percent * n)
            got = {"n_words": n, "word_chars": chars, "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts]), "n_dup_lines": np.array([m[2] for m in made]), "n_repeat_words": again, "content_share": share, "base_failed": failed, "kept": ~failed & (share >= settings.share)}
            return {prefix + k: v for k, v in got.items()}

        return work

    return with_columns(docs, ", ".join(prefix + c for c in ADDED.split(", ")), make, rows=128)

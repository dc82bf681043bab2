"""Secret scan with a random forest against false findings, in SQL functions only.

One regular expression finds candidates; the text is cut around them, so that each has its neighbouring words.  Features of a
candidate (length, character transitions, dictionary coverage, path, neighbouring words) and the forest's trees are SQL
expressions inside array functions: a text is read once, nothing is shuffled, and rows stay whole.  The forest itself is
trained on the driver, on labelled findings of bounded number whose features come from the same expressions.
"""

from __future__ import annotations

import random
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A text is cut at ``CUT``; its own ``\x01`` become ``\x01\x03`` before that and come back after it, so no text holds a cut.
OWN, KEPT, CUT = "\x01", "\x01\x03", "\x01\x02"
#: A name and an assignment before a value (group 1, kept in the neighbouring words, and 2), a password inside an address (3 and
#: 4), or a value that stands alone (5).  Nothing has an upper length: possessive quantifiers take a whole token in one pass.
NAME = (
    r"""((?i:api_?key|access_?key|key|token|secret|passw(?:or)?d|pwd|credentials?)["']?\s*+[:=]\s*+["']?"""
    r"""|(?i:authorization)["']?\s*+[:=]\s*+["']?(?i:bearer|basic|token)\s++["']?|(?i:bearer)\s++(?=[A-Za-z._~+/=-]*+[0-9]))"""
)
VALUE = r"([\p{L}\p{N}_+/=.~@!$%^-]{6,}+)"
ADDRESS = r"""(://[^\s:/@"'<>]*+:)([^\s@/"'<>]++)(?=@)"""
ALONE = "|".join(  # literals come first: most positions fail at their first character
    [
        r"AKIA(?<![A-Za-z0-9]AKIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
        r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s:,.]*+(?:-(?!----END)[A-Za-z0-9+/=\s:,.]*+)*+(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?",
        r"gh[pousr]_(?<![A-Za-z0-9]gh[pousr]_)[A-Za-z0-9]{30,}+",
        r"xox[abprs]-(?<![A-Za-z0-9]xox[abprs]-)[A-Za-z0-9-]{10,}+",
        r"sk-(?<![A-Za-z0-9]sk-)[A-Za-z0-9]{20,}+",
        r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+",
        r"(?<![A-Za-z0-9_+/=.@-])[A-Za-z_+/=-]*+[0-9][A-Za-z0-9_+/=-]*+(?![A-Za-z0-9_+/=@-])(?<=[A-Za-z0-9_+/=-]{20})",
    ]
)
PATTERN = f"{NAME}{VALUE}|{ADDRESS}|({ALONE})"
BEFORE, AFTER = 48, 24
#: White space of any width between a name and its value counts as one space among the neighbouring words.
WIDE = r"""(?<!\s)\s++(["']?)$"""

#: Common words of prose and of code, for dictionary coverage.
DICTIONARY = (
    "the and for with this that from have not are was you your all can will one value name user pass word password secret token "
    "key api access login admin test example sample dummy fake here change placeholder default string data file path home config "
    "client server service request response header get set find load save create update delete return null none true false id "
    "index count list map item time date version commit branch master main build release public private"
).split()

#: Neighbouring letters inside words of the dictionary; others are odd.
PAIRS, LETTERS = sorted({w[i : i + 2] for w in DICTIONARY for i in range(len(w) - 1)}), "[a-z][a-z]"

FEATURES = {
    "chars": "double(length(c))",
    "moves": "regexp_count(c, '(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^a-zA-Z0-9])[a-zA-Z0-9]') / double(length(c))",
    "to_digit": "regexp_count(c, '[A-Za-z](?=[0-9])') / double(length(c))",
    "to_upper": "regexp_count(c, '[a-z](?=[A-Z])') / double(length(c))",
    "odd_pairs": f"regexp_count(lower(c), '(?={LETTERS})(?!{'|'.join(PAIRS)})') / double(length(c))",
    "distinct": "size(array_distinct(split(c, ''))) / double(length(c))",
    "digits": "length(regexp_replace(c, '[^0-9]', '')) / double(length(c))",
    "words": f"1 - length(regexp_replace(lower(c), '{'|'.join(sorted(DICTIONARY, key=len, reverse=True))}', '')) / double(length(c))",
    "hex": "double(c rlike '^[0-9a-f]+$')",
    "spaced": "regexp_count(c, '[-_.]') / double(length(c))",
    "prefix": "double(c rlike '^(AKIA|gh[pousr]_|xox[abprs]-|sk-|eyJ|-----BEGIN)')",
    "stub": "double(lower(c) rlike 'example|xxx|your|change|dummy|placeholder|sample|redact|1234|abcd|0000|insert|todo|process.env|none|null')",
    "named": "double(lower(l) rlike 'key|token|secret|passw|pwd|auth|credential|bearer|://[^/@]*:$')",
    "assigned": "double(lower(l) rlike '([:=]|bearer|basic)\\\\s*[\"'']?$')",
    "quoted": "double(l rlike '[\"'']$' and r rlike '^[\"'']')",
    "told_not": "double(lower(concat(l, ' ', r)) rlike '(?<![a-z.@])(example(?!\\.(com|net|org))|dummy|fake|placeholder|sample|commit|sha1|sha256|md5|checksum|uuid|revision|hash|digest|etag|trace)(?![a-z])')",
    "path": "double(lower(p) rlike '(^|[/._-])(tests?|examples?|fixtures?|samples?|mocks?|docs?)([/._-]|$)')",
}


@dataclass
class Settings:
    trees: int = 15
    depth: int = 6
    leaf: int = 4
    rows: int = 2400  # bound of the labelled findings
    seed: int = 13
    threshold: float = 0.5
    mask: str = "[SECRET]"


def labelled_findings(rows: int, seed: int) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings made by rule: ``before, candidate, after, path, label``.  Half are secrets."""
    r = random.Random(seed)
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    mixed, hexes, caps = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits
    prose = lambda n: " ".join(pick(string.ascii_lowercase, r.randint(1, 9)) + r.choice(["", "", "", ".", ","]) for _ in range(n))
    code = ["const x = 1;\n", "import os\n", "config.yaml\n", "  - env:\n", "export ", "var ", "# settings\n"]
    setting = lambda: prose(r.randint(2, 8)) + " " if r.random() < 0.7 else r.choice(code)
    paths = ["", "", "", "src3", "src/app.py", "deploy/prod.yml", "lib/client.js", "notes.txt"]
    odd = ["tests/test_auth.py", "examples/demo.py", "docs/setup.md", "fixtures/keys.json"]
    names = ["token", "secret", "password", "api_key", "apikey", "passwd", "pwd", "secret_key", "access_token", "client_secret", "PASSWORD", "DB_PASSWORD", "API_KEY"]

    def assign() -> tuple[str, str]:
        q = r.choice(["", "", '"', '"', "'"])
        return r.choice(names) + r.choice(["=", " = ", ": ", ":", '": ']) + q, q

    def good():
        before, q, after = setting(), "", " " + prose(3)
        kind = r.randrange(11)
        if kind == 8:
            head = r.choice(["", "RSA ", "EC ", "OPENSSH "]) + "PRIVATE KEY-----"
            return before, f"-----BEGIN {head}\n" + "\n".join(pick(mixed + "+/", 64) for _ in range(r.randint(1, 20))) + f"\n-----END {head}", after
        if kind == 9:
            where = r.choice(["postgres", "mysql", "amqp", "https", "redis", "mongodb"]) + "://" + r.choice(["", "app", "user", "admin", pick(string.ascii_lowercase, 6)])
            return before + where + ":", pick(mixed + "!$%", r.randint(6, 24)), "@" + r.choice(["db", "host", "10.0.0.7", "example.com"]) + r.choice([":5432/", "/", " "]) + prose(2)
        if kind == 10:
            return before + r.choice(["Authorization: Bearer ", "authorization: bearer ", '"Authorization": "Bearer ', "Bearer ", "Authorization: Basic "]), pick(mixed + "_-.", r.randint(20, 60)) + r.choice(["", "=="]), after
        if kind == 0:
            return before, "AKIA" + pick(caps, 16), after
        if kind == 1:
            return before, r.choice(["ghp_", "gho_", "ghs_"]) + pick(mixed, 36), after
        if kind == 2:
            return before, r.choice([f"xoxb-{pick(string.digits, 11)}-{pick(mixed, 24)}", "sk-" + pick(mixed, 40)]), after
        if kind == 3:
            return before, f"eyJ{pick(mixed, 20)}.{pick(mixed, 50)}.{pick(mixed, 30)}", after
        name, q = assign()
        value = pick(hexes, r.choice([16, 18, 20, 24, 32, 40, 48, 64])) if kind in (4, 5) else pick(mixed + "_+/-" + r.choice(["", "", "éüñßλ"]), r.randint(14, 60)) if kind == 6 else pick(mixed + "!@$%", r.randint(9, 16))
        return before + name, value, q + r.choice([" ", "\n", "### ", "; "]) + prose(3)

    def bad():
        before, after = setting(), " " + prose(3)
        word = lambda: r.choice(DICTIONARY)
        kind = r.randrange(10)
        if kind == 9:
            where = r.choice(["postgres", "mysql", "https", "amqp"]) + "://" + r.choice(["user", "name", "username"])
            return before + where + ":", r.choice(["password", "pass", "your_password", "changeme", "xxxx", "secret", "placeholder"]), "@" + r.choice(["host", "example.com", "localhost"]) + r.choice(["/", " "]) + prose(2)
        if kind == 0:
            return before + r.choice(["commit ", "revision ", "sha1 ", "hash: ", "checksum "]), pick(hexes, 40), after
        if kind == 1:
            return before + r.choice(["md5 ", "sha256:", "digest=", "etag: ", "uuid "]), pick(hexes, r.choice([32, 64])), after
        if kind == 2:
            u = pick(hexes, 32)
            return before + r.choice(["uuid=", "trace ", "id ", ""]), f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}", after
        if kind == 3:
            return before, r.choice(["", "-", "_"]).join(word().title() for _ in range(5)) + pick(string.digits, 2), after
        if kind == 4:
            return before, pick(string.digits, r.randint(20, 30)), after
        if kind == 5:
            return before, "AKIA" + r.choice(["IOSFODNN7EXAMPLE", "XXXXXXXXXXXXXXXX", "0000000000000000", "EXAMPLEKEY123456"]), after
        name, q = assign()
        if kind == 6:
            value = r.choice(["your_" + word() + "_here", "changeme", "xxxxxxxxxxxx", "example-" + word(), "placeholder", "********"[:6] + "xxx", "dummy_" + word(), "test1234", "insert-" + word(), "process.env." + word().upper(), "1234567890"])
        elif kind == 7:
            value = r.choice(["_", ".", "-"]).join(word() for _ in range(r.randint(2, 4)))
        else:
            value = pick(string.ascii_lowercase, r.randint(6, 12))
        return before + name, value, q + " " + prose(3)

    out = []
    for i in range(rows):
        label = i % 2
        if r.random() < 0.06:  # what stands in test material is no secret, however it looks
            b, c, a = good()
            out.append((b[-BEFORE:], c, a[:AFTER], r.choice(odd), 0))
        else:
            b, c, a = good() if label else bad()
            out.append((b[-BEFORE:], c, a[:AFTER], r.choice(paths if label or r.random() < 0.6 else odd), label))
    return out


def features_sql(l: str, c: str, r: str, p: str) -> str:  # noqa: E741
    """A struct of the features of candidate ``c`` between ``l`` and ``r`` at path ``p``."""
    names = ", ".join(f"'{k}', {v}" for k, v in FEATURES.items())
    return f"transform(array(named_struct('c', {c}, 'l', {l}, 'r', {r}, 'p', {p})), x -> {_qualified(names)})[0]"


def _qualified(sql: str) -> str:
    """``c, l, r, p`` as fields of ``x``, outside of string literals."""
    import re

    out, quoted = [], False
    for piece in re.split(r"(')", sql):
        if piece == "'":
            quoted = not quoted
        elif not quoted:
            piece = re.sub(r"\b([clrp])\b", r"x.\1", piece)
        out.append(piece)
    return f"named_struct({''.join(out)})"


def grow(x: np.ndarray, y: np.ndarray, s: Settings) -> list:
    """A random forest: nodes are ``(feature, threshold, left, right)`` or a probability."""
    rng = np.random.default_rng(s.seed)
    some = max(2, int(x.shape[1] ** 0.5) + 1)

    def node(rows: np.ndarray, depth: int):
        p = y[rows].mean()
        if depth == 0 or len(rows) < 2 * s.leaf or p in (0, 1):
            return round(float(p), 4)
        best = (np.inf, 0, 0.0)
        for f in rng.choice(x.shape[1], some, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, pos = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(order))
            left, right = pos[:-1] / n, (pos[-1] - pos[:-1]) / (len(order) - n)
            cost = n * left * (1 - left) + (len(order) - n) * right * (1 - right)
            cost[(v[1:] == v[:-1]) | (n < s.leaf) | (len(order) - n < s.leaf)] = np.inf
            i = int(cost.argmin())
            if cost[i] < best[0]:
                best = (cost[i], f, round(float((v[i] + v[i + 1]) / 2), 6))
        if not np.isfinite(best[0]):
            return round(float(p), 4)
        go = x[rows, best[1]] <= best[2]
        return int(best[1]), best[2], node(rows[go], depth - 1), node(rows[~go], depth - 1)

    return [node(rng.integers(0, len(x), len(x)), s.depth) for _ in range(s.trees)]


def forest_sql(forest: list, f: str) -> str:
    """The mean of the trees over the feature struct ``f``."""
    names = list(FEATURES)

    def one(n) -> str:
        return f"{n}D" if isinstance(n, float) else f"if({f}.{names[n[0]]} <= {n[1]}D, {one(n[2])}, {one(n[3])})"

    return "(" + " + ".join(one(t) for t in forest) + f") / {len(forest)}D"


def train(spark: SparkSession, labelled: DataFrame | None = None, s: Settings = Settings()) -> list:
    """A forest from labelled findings (``before, candidate, after, path, label``); by default those made by rule."""
    if labelled is None:
        labelled = spark.createDataFrame(labelled_findings(s.rows, s.seed), "before string, candidate string, after string, path string, label int")
    rows = labelled.select(F.expr(features_sql("before", "candidate", "after", "path")).alias("f"), F.col("label")).limit(s.rows).collect()
    return grow(np.array([list(r["f"]) for r in rows], float), np.array([r["label"] for r in rows], float), s)


def with_findings(docs: DataFrame, forest: list, s: Settings = Settings(), text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``_parts`` (the text cut at candidates) and ``_found`` (``candidate, before, after, score`` of each).

    Null and empty texts have none.  Rows are scanned one by one, so ties and repeated rows are no special case.
    """
    sql = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    col = f"`{text}`"
    where = f"coalesce(cast(`{path}` as string), '')" if path else "''"
    cuts = f"split(regexp_replace(replace(coalesce({col}, ''), '{OWN}', '{KEPT}'), {sql(PATTERN)}, '$1$3{CUT}$2$4$5{CUT}'), '{CUT}')"
    marked = docs.withColumn("_parts", F.expr(f"transform({cuts}, x -> replace(x, '{KEPT}', '{OWN}'))"))
    cut = f"""if(size(_parts) < 3, array(), transform(sequence(1, size(_parts) - 2, 2), i -> named_struct(
        'candidate', _parts[i], 'before', right(regexp_replace(_parts[i - 1], {sql(WIDE)}, ' $1'), {BEFORE}), 'after', left(_parts[i + 1], {AFTER}))))"""
    found = marked.withColumn("_cut", F.expr(cut))
    found = found.withColumn("_features", F.expr(f"transform(_cut, y -> {features_sql('y.before', 'y.candidate', 'y.after', where)})"))
    score = f"transform(_features, f -> {forest_sql(forest, 'f')})"
    found = found.withColumn("_scores", F.expr(score))
    return found.withColumn("_found", F.expr("transform(arrays_zip(_cut, _scores), z -> named_struct('candidate', z._cut.candidate, 'before', z._cut.before, 'after', z._cut.after, 'score', z._scores))")).drop("_cut", "_features", "_scores")


def findings(docs: DataFrame, forest: list, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row for each candidate: ``doc_id, finding, candidate, before, after, score, is_secret``, in the text's order.

    Null and empty texts give none; a null ``path`` is an empty one; null ids stay, and rows that share an id are numbered apart.
    """
    keep = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("_t"), (docs[path] if path else F.lit("")).alias("_p"))
    rows = with_findings(keep, forest, s, "_t", "_p").filter(F.size("_found") > 0).select("doc_id", F.posexplode("_found").alias("finding", "f"))
    return rows.select("doc_id", "finding", "f.candidate", "f.before", "f.after", "f.score", (F.col("f.score") >= s.threshold).alias("is_secret"))


def redact(docs: DataFrame, forest: list, s: Settings = Settings(), text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by the mask; other texts, null and empty ones among them, stay as they are.

    A null ``path`` is an empty one.  Rows are masked one by one, repeated ones alike; other columns stay.
    """
    found = with_findings(docs, forest, s, text, path)
    put = f"""if(exists(_found, f -> f.score >= {s.threshold}D), array_join(transform(_parts, (x, i) ->
        if(i % 2 = 1 and _found[cast((i - 1) / 2 as int)].score >= {s.threshold}D, '{s.mask}', x)), ''), `{text}`)"""
    return found.withColumn(text, F.expr(put)).select(*docs.columns)

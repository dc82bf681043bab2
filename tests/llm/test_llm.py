"""The training-data operators against brute force, round trips and held-out accuracy, with nulls, ties and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from matforge.llm import chat, common, lm, minhash, packing, pieces, quality, secrets, spherical, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=300):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}x" for _ in range(n)]


def docs(spark, texts, **extra):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


ODD = [None, "", "   \n\t ", "one", "a b", "x " * 30_000, "a b", "é ü 日本 🙂"]


# ---- chat


def test_chat_round_trip():
    texts = ["", "plain", "</s>[INST] ok [/INST]", "[\\INST]", "<\\\\s>", "[/IN", "[[INST]]", "[AS]", "a\n\\", "[ROLE]x[AS]y[/ROLE]"]
    for role in ("user", "system", "assistant", "tool", "", "[AS]", "[INST]"):
        for t in texts:
            out = chat.render_turn(role, t)
            assert [x[:2] for x in chat.parse(out)] == [(role, t)]
    whole = "".join(chat.render_turn("user", t) + chat.render_turn("assistant", t) for t in texts)
    assert [x[:2] for x in chat.parse(whole)] == [(r, t) for t in texts for r in ("user", "assistant")]
    for broken in ("x", "[INST]a", "[INST]a[/SYS]", "[INST]a[INST]b[/INST]", "[/INST]"):
        with pytest.raises(chat.GrammarError):
            list(chat.parse(broken))


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, "<s>"), (1, 2, "assistant", "ü</s>"), (1, 2, "assistant", "ü</s>"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.ordered(chat.format_turns(df))).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256("user\n\nassistant\nb\nassistant\nü</s>\nassistant\nü</s>\n".encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256("bü</s>ü</s>".encode()).hexdigest() and got[1]["loss_chars"] == 11
    assert got[2]["n_turns"] == 1 and got[None]["n_turns"] == 1
    whole = {r["conv_id"]: r for r in chat.conversations(chat.format_turns(df)).collect()}
    assert len(whole[1]["text"]) == got[1]["formatted_chars"]
    span = whole[1]["loss_spans"][0]
    assert whole[1]["text"][span["start"] : span["start"] + span["length"]] == "b"
    assert chat.read_back(chat.ordered(chat.format_turns(df.limit(0)))).count() == 0


# ---- secrets


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(spark)


def test_secret_forest(spark, forest):
    rows = secrets.labelled_findings(400, 99)
    df = spark.createDataFrame(rows, "before string, candidate string, after string, path string, label int")
    got = df.select("label", F.expr(secrets.features_sql("before", "candidate", "after", "path")).alias("f")).select("label", F.expr(secrets.forest_sql(forest, "f")).alias("s")).collect()
    assert sum((r["s"] >= 0.5) == (r["label"] == 1) for r in got) / len(got) > 0.97


def test_secret_findings(spark, forest):
    key = "AKIA" + "3C7JKHPWSSBHKS2S"
    texts = [f"use {key} here and token = \"{'9b0b3c6a43eb78aa99cb' * 2}\" end", "commit 9b0b3c6a43eb78aa99cb9b0b3c6a43eb78aa99cb done", "password=changeme now", *ODD, f"\x01\x02\x01 {key}"]
    df = docs(spark, texts, candidate="clash", score=1)
    got = secrets.findings(df, forest, path="source").collect()
    true = [(r["doc_id"], r["candidate"]) for r in got if r["is_secret"]]
    assert true == [(0, key), (0, "9b0b3c6a43eb78aa99cb" * 2), (len(texts) - 1, key)]
    clean = {r["doc_id"]: r for r in secrets.redact(df, forest, path="source").collect()}
    assert clean[0]["text"] == 'use [SECRET] here and token = "[SECRET]" end'
    assert all(clean[i]["text"] == t for i, t in enumerate(texts[1:-1], 1)) and clean[0]["candidate"] == "clash"
    assert secrets.findings(df.limit(0), forest).count() == 0


def test_long_secrets(spark, forest):
    r = random.Random(4)
    mixed = lambda n: "".join(r.choice("abcdefghijkmnopqrstuvwyzABCDEFGHJKLMNPQRSTUVWYZ23456789") for _ in range(n))
    jwts = [f"eyJ{mixed(33)}.{mixed(n)}.{mixed(m)}" for n, m in ((900, 43), (560, 683), (5000, 683))]
    named = [mixed(n) for n in (300, 1000, 5000)] + jwts
    texts = [f'see api_key="{v}" end' for v in named]
    whole = named + [f"{p}{mixed(n)}" for p in ("ghp_", "xoxb-", "sk-") for n in (300, 5000)] + jwts + [mixed(300), mixed(5000)]
    texts += [f"see {v} end" for v in whole[len(named) :]]
    df = docs(spark, texts)
    assert [x["candidate"] for x in secrets.findings(df, forest).orderBy("doc_id", "finding").collect()] == whole
    clean = [x["text"] for x in secrets.redact(df, forest).orderBy("doc_id").collect()]
    assert clean[: len(named)] == ['see api_key="[SECRET]" end'] * len(named)
    assert clean[len(named) : -2] == ["see [SECRET] end"] * (len(whole) - len(named) - 2)


# ---- vectors


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    near = [b + rng.normal(size=16) * 0.03 * np.linalg.norm(b) / 4 for b in base[:12] for _ in range(4)]
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate([*base, *near])]
    n = len(rows)
    rows += [(n, rows[0][1], 0), (n + 1, None, 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, [None] * 16, 0), (n + 5, rows[0][1], None), (n + 6, rows[0][1][:8], 0), (n + 7, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cls", F.lit(5))
    got = {r["vec_id"]: r for r in spherical.near_vectors(df, spherical.Settings(block=8)).collect()}
    good = [(i, np.array(v, float), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = defaultdict(set)
    for i, v, y in good:
        for j, w, z in good:
            if i != j and y == z and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[i].add(j)
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links[i]), min(seen), i == min(seen))
    assert spherical.near_vectors(df.limit(0)).count() == 0


def pairs_at(n, dim, cosine, seed):
    u, v = np.random.default_rng(seed).normal(size=(2, n, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v -= (u * v).sum(1, keepdims=True) * u
    return u, cosine * u + (1 - cosine**2) ** 0.5 * v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("n", [2_000, 1_000_000, 30_000_000])
def test_filters_of_pairs_at_the_threshold(n):
    s = spherical.Settings()
    codes = spherical.Codes(64, spherical.words_for(n, s), s)
    u, v = pairs_at(4000, 64, 0.98, 5)
    assert all(len(np.intersect1d(a, b)) for a, b in zip(codes.decode(u), codes.decode(v)))
    assert codes.missed ** len(codes.codes) <= 1e-8


def test_near_vectors_at_the_threshold(spark):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.stack(pairs_at(6000, 64, 0.980001, 8), 1).reshape(-1, 64))]
    got = spherical.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert [(r["n_links"], r["component_id"]) for r in sorted(got)] == [(1, i - i % 2) for i in range(12000)]


# ---- toxicity and quality


def test_toxicity(spark):
    r = random.Random(1)
    bad, texts, labels = ["gronk", "zilch"], [], []
    for i in range(600):
        t = words(r.randint(5, 60), i)
        labels.append(i % 3 == 0)
        if labels[-1]:
            t.insert(r.randrange(len(t)), r.choice(bad))
        texts.append(" ".join(t))
    net = toxicity.train(texts[:450], [int(y) for y in labels[:450]])
    df = docs(spark, texts[450:] + ODD, score="clash")
    got = [x["score"] for x in toxicity.score_texts(df, net).orderBy("doc_id").collect()]
    assert sum((s >= 0.5) == y for s, y in zip(got, labels[450:])) >= 145
    assert all(0 <= s <= 1 for s in got) and got[150] == got[151] == got[152]
    assert toxicity.score_texts(df.limit(0), net).count() == 0
    assert toxicity.train([], []).score(*toxicity.WordHasher(18)(["x"], 2))[0] < 0.5


def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = defaultdict(list)
    for i in range(len(w) - 4):
        grams[tuple(w[i : i + 5])].append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines, seen, dup = t.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality(spark):
    clean = ["\n".join(" ".join(words(12, 50 * i + j)) + "." for j in range(5)) for i in range(60)]
    junk = ["\n".join(" ".join(w + "###" for w in words(12, 7000 + 50 * i + j)) for j in range(5)) for i in range(60)]
    field = quality.train(clean[:40] + junk[:40], [1] * 40 + [0] * 40)
    texts = clean[40:] + junk[40:] + ODD + ["\n".join(["same line with words"] * 9), "a b c d e f g h i j " * 3]
    got = quality.judge_texts(docs(spark, texts, kept="clash"), field).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute_quality(t)
    assert [r["kept"] for r in got[:40]] == [True] * 20 + [False] * 20 and not any(r["kept"] for r in got[40:45])
    assert quality.judge_texts(docs(spark, texts).limit(0), field).count() == 0


def test_viterbi():
    rng = np.random.default_rng(2)
    f = quality.Field()
    f.move, f.first = rng.normal(size=(2, 2)), rng.normal(size=2)
    parts = [rng.normal(size=n) for n in (1, 4, 7)]
    got = f.viterbi(*quality.padded(parts))
    for row, e in zip(got, parts):
        def score(y):
            return f.first[y[0]] + sum(v for v, k in zip(e, y) if k) + sum(f.move[a, b] for a, b in zip(y, y[1:]))
        best = max((tuple(int(c) for c in f"{k:0{len(e)}b}") for k in range(2 ** len(e))), key=score)
        assert tuple(row[: len(e)]) == best


# ---- language model


def test_lm(spark):
    texts = [" ".join(words(40, i, 60)) for i in range(120)] + ODD
    df = docs(spark, texts, score="clash").withColumn("held_out", common.held_out("doc_id", 10))
    s = lm.Settings(core=20, classes=8, lookup=30, batch=64)
    trained = lm.train(df.filter("not held_out"), s)
    c = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 10:
            c.update(lm.words_of(t or ""))
    n, v = sum(c.values()), len(c)
    got = lm.score_texts(df, trained).collect()
    assert len(got) == len(texts)
    for r in got:
        w = lm.words_of(texts[r["doc_id"]] or "")
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    near, far, z = trained.model.tables()
    p = np.exp(near[3].astype(float) + far[5] - z[3, 5])
    assert p.sum() == pytest.approx(1, abs=1e-4)
    assert lm.train(df.limit(0), s).tokens == 0


# ---- archives


def test_warc(spark):
    long = "<p>ü🙂</p>" * 4000
    same = "y" * 1000
    rows = [(1, "http://a", same), (2, "http://b", same), (3, None, None), (4, "http://d", long), (5, "http://e", "y" * 999), (6, "http://f", "y" * 999), (7, "http://g", "\r\n\r\nWARC/1.1\r\n\r\n"), (2, "http://b", same)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    got = warc.round_trip(df, segment=5000, chunk=700).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for i, _, h in rows if i == r["page_id"]) or ""
        assert r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest() and r["payload_bytes"] == len(html.encode())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 2) if r["page_id"] == 1 else ("response", None))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_payloads(spark):
    long, same = "<p>ü🙂</p>" * 4000, "y" * 1000
    rows = [(1, "http://a", same), (2, "http://b", same), (3, None, None), (4, "http://d", long), (5, "http://e", "\r\n\r\nWARC/1.1\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["payload"] for r in warc.round_trip(df, segment=5000, chunk=700).collect()}
    assert got == {i: None if i == 1 else bytearray((h or "").encode()) for i, _, h in rows}


def test_warc_errors():
    parts = list(warc.page_records(1, "u", "abc" * 100, None, "", "00000000-0000-0000-0000-000000000001", 100, 30))
    assert len(parts) > 3 and "WARC-Segment-Total-Length" in parts[-1]
    assert [h["warc-type"] for h, _ in warc.parse_records([bytes([x]) for x in "".join(p + warc.END for p in parts).encode()])] == ["response"] + ["continuation"] * (len(parts) - 1)
    for broken in (b"5\r\nabc", b"3\r\nabcX\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(broken)
    with pytest.raises(ValueError):
        list(warc.parse_records([parts[0].encode()]))


# ---- packing


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    texts = [" ".join(words(40 * i, i)) for i in range(20)] + ODD + ["<|endoftext|> A<|startoftext|>b it's Don'T x\x1cz ́a ΑΣ"]
    t = Tokenizer.from_file(path)
    got = packing.pack_documents(docs(spark, texts, start="clash").repartition(3), path, capacity=256).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, x in enumerate(texts):
        ids, at = t.encode(x or "", add_special_tokens=False).ids + [2], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256 and at & (at - 1) == 0  # full, or a power of two: no padding
    assert packing.pack_documents(docs(spark, texts).limit(0), path).count() == 0


def test_packed_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    texts = [" ".join(words(40 * i, i)) for i in range(20)] + ODD
    t, by_seq, back = Tokenizer.from_file(path), defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(docs(spark, texts).repartition(3), path, capacity=256).collect():
        by_seq[r["sequence_id"]].append(r)
    for rows in by_seq.values():
        sequence = [x for r in sorted(rows, key=lambda r: r["offset"]) for x in r["ids"]]
        for r in rows:
            back[r["doc_id"]].append((r["start"], sequence[r["offset"] : r["offset"] + r["length"]]))
    for i, x in enumerate(texts):
        assert [k for _, p in sorted(back[i]) for k in p] == t.encode(x or "", add_special_tokens=False).ids + [2]


# ---- near duplicates


def brute_components(texts, size, percent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    out = list(range(len(texts)))
    changed = True
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in pairs:
            m = min(out[i], out[j])
            changed |= out[i] != m or out[j] != m
            out[i] = out[j] = m
    return sets, out


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    r = random.Random(size)
    texts = []
    for g in range(6):
        base = words(80, g, 5000)
        texts.append(" ".join(base))
        for _ in range(12):
            t = list(base)
            for _ in range(r.choice([1, 2, 3, 5, 8])):
                t[r.randrange(len(t))] = f"e{r.random()}"
            texts.append(" ".join(t))
    texts += [texts[3].upper(), texts[0], *ODD, "one"]
    sets, component = brute_components(texts, size)
    got = {x["doc_id"]: x for x in minhash.near_duplicates(docs(spark, texts, component="clash"), minhash.Settings(shingle=size, block=4)).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), component[i], component[i] == i)


def test_near_duplicates_empty(spark):
    assert minhash.near_duplicates(docs(spark, ["a"]).limit(0)).count() == 0
    rows = minhash.near_duplicates(docs(spark, ["a b c", "a b c"]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in rows) == [(0, 1, False), (1, 1, True)]


# ---- pieces


def test_pieces(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        proto = f.read()
    sp, codec = sentencepiece.SentencePieceProcessor(model_proto=proto), pieces.Codec(proto)
    texts = [" ".join(words(50, i)) for i in range(20)] + [t or "" for t in ODD] + ["  a  b ", "\n\ttabs", "aaaab" * 30, " " * 90, "naïve Größe—isn't 2024", "<s> <0x0A>", "x" * 3000]
    for t in texts:
        assert codec.encode(t) == sp.encode(t) and codec.decode(codec.encode(t)) == t
    for size in (1, 5, 10_000):
        stream, out, whole = pieces.Stream(codec.v, pieces.Transitions(codec.v)), [], pieces.SPACE + "streaming▁over▁a▁long▁text" * 20
        for at in range(0, len(whole), size):
            out += stream.feed(whole[at : at + size])
            assert len(stream.text) < 200  # the window stays bounded
        assert [i for p in out + stream.finish() for i in codec.v.ids(p)] == sp.encode("streaming over a long text" * 20)
    df = docs(spark, ODD, n_ids="clash")
    assert all(r["round_trip"] for r in pieces.round_trip(df, path).collect())
    back = pieces.decode_ids(pieces.encode_texts(df, path), path).orderBy("doc_id").collect()
    assert [r["decoded"] for r in back] == [t or "" for t in ODD]
    assert pieces.round_trip(df.limit(0), path).count() == 0

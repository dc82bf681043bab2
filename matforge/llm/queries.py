"""The training-data queries by name, and SQL where it can express their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, chat, collocations, common, lm, minhash, packing, pieces, quality, secrets, spherical, toxicity, warc


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(common.read_table(spark, sf_dir, "pages")).drop("payload")


OP7_SQL = """
WITH p AS (
    SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), h AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS head FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN head <> page_id THEN head END AS refers_to
FROM h
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.read_table(spark, sf_dir, "documents"), word_bpe_path()).drop("ids")


def toxicity_net(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Net:
    """The classifier learned from the labelled rows of ``docs`` whose crc32 leaves a remainder by 5."""
    settings = toxicity.Settings()
    labels = common.read_table(spark, sf_dir, "labels")
    texts, y = toxicity.labelled_sample(docs, labels, lambda c: ~common.held_out(c, 5), "toxic", settings)
    return toxicity.train(texts, y, settings)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    scored = toxicity.score_texts(docs.select("doc_id", "text"), toxicity_net(spark, docs, sf_dir))
    return scored.select("doc_id", common.held_out("doc_id", 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_field(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Field:
    settings = quality.Settings()
    labels = common.read_table(spark, sf_dir, "labels")
    return quality.train(*toxicity.labelled_sample(docs, labels, lambda c: F.lit(True), "quality", settings), settings)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    judged = quality.judge_texts(docs.select("doc_id", "text"), quality_field(spark, docs, sf_dir))
    return judged.drop("text", "content_share")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = common.held_out("doc_id", 10)
    trained = lm.train(docs.filter(~out))
    return lm.score_texts(docs.withColumn("held_out", out), trained)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.read_table(spark, sf_dir, "documents"), minhash.Settings(shingle=2))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("SELECT -1L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS x(t, r)")
    return chat.read_back(chat.ordered(chat.format_turns(rows.unionByName(own))))


OP1_SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(t, r)
), f AS (
    SELECT *, length(regexp_replace(text, '([\[<])(\\*)(/?(?:INST|SYS|ROLE)\]|AS\]|/?s>)', '\1\\\2\3', 'g'))
        + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 7
          ELSE 17 + length(regexp_replace(role, '([\[<])(\\*)(/?(?:INST|SYS|ROLE)\]|AS\]|/?s>)', '\1\\\2\3', 'g')) END AS chars
    FROM c
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
""".replace("\\\\", "\\\\")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical.near_vectors(common.read_table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE e AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
), ok AS (
    SELECT *, sqrt(list_dot_product(v, v)) AS n FROM e
    WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98
), reach AS (
    SELECT vec_id AS id, vec_id AS to_id FROM embeddings
    UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.to_id = l.a
), comp AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id)
SELECT m.vec_id, coalesce(k.n_links, 0) AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m JOIN comp c ON c.id = m.vec_id
LEFT JOIN (SELECT a, CAST(count(*) AS BIGINT) AS n_links FROM links GROUP BY a) k ON k.a = m.vec_id
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(common.read_table(spark, sf_dir, "documents"), secrets.train(spark), path="source")
    return found.select("doc_id", "finding", F.length("candidate").alias("candidate_chars"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.round_trip(common.read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(common.read_table(spark, sf_dir, "embeddings"))[0]


def _op11_sql(clusters: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> str:
    """Rounds written out: every vector meets all centroids, in integers."""
    floor = "((s - ((s % n) + n) % n) // n)"
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL) ORDER BY h, v LIMIT {clusters})",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v, k, d FROM (SELECT x.vec_id, x.v, c.k, d, row_number() OVER (PARTITION BY x.i ORDER BY d, c.k) AS n FROM (SELECT *, row_number() OVER () AS i FROM kept) x, c{r} c,
        LATERAL (SELECT CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d)) WHERE n = 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT k, list({floor} ORDER BY i) AS v FROM
            (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY k, i) GROUP BY k) m ON m.k = c.k)""")
    return f"""WITH {", ".join(parts)}
    SELECT a.vec_id, CAST(a.k AS INT) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.k = c.k"""


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(common.read_table(spark, sf_dir, "documents"), word_bpe_path())


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(common.read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
    SELECT lang, m, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM (SELECT lang, piece, count(*) AS m FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
    ) GROUP BY ALL)
), g AS MATERIALIZED (
    SELECT lang, k AS size, phrase, CAST(sum(m) AS BIGINT) AS f FROM (
        SELECT lang, m, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, (VALUES (1), (2), (3), (4)) AS x(k)
    ) GROUP BY ALL
), t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM g WHERE size >= 2 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (
    SELECT x.lang, x.phrase, x.a, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * x.a // (l.f + r.f) AS BIGINT) AS score, x.k
    FROM cuts x JOIN g l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.k], ' ') JOIN g r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.k + 1:], ' ')
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM c WHERE size >= 3)) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN t ON t.lang = b.lang LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE i.most IS NULL OR 100::HUGEINT * i.most < 80::HUGEINT * a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) <= 2000
""".replace("\\", "\\"[:1])


def corpus_pipeline_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_secret_scan": op2_secret_scan,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_warc": op7_warc,
    "op8_packing": op8_packing,
    "op9_minhash": op9_minhash,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_centroids": op11_centroids,
    "op12_bpe": op12_bpe,
    "op13_collocations": op13_collocations,
    "pipeline": corpus_pipeline_run,
}
ORACLES: dict[str, str] = {"op1_chat_format": OP1_SQL, "op3_embedding_dedup": OP3_SQL, "op7_warc": OP7_SQL, "op11_centroids": _op11_sql(), "op13_collocations": OP13_SQL}

"""Registered queries of this subpackage and their SQL. Each query applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tideledger.llm import audit, bpe, decontaminate, fingerprint, langid, mtree, passages, periodic, pitmanyor, ruleset, sharding, simhash, warc
from tideledger.llm.common import fold, table
from tideledger.session import scratch, stage

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return keep


#: CRC-32 over the bytes of a text: its 256-step table is built from the polynomial.
_CRC = """
WITH RECURSIVE step(n, k, c) AS (
    SELECT n::BIGINT, 0, n::BIGINT FROM range(256) t(n)
    UNION ALL
    SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
),
crc AS (SELECT list(c ORDER BY n) AS t FROM step WHERE k = 8),
body AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
coded AS (
    SELECT doc_id, octet_length(encode(text)) + 1 AS size,
        xor(list_reduce(list_prepend(4294967295::BIGINT,
            list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
    FROM body, crc
)"""

_RENDEZVOUS = (
    _CRC
    + """,
scored AS (
    SELECT doc_id, size, text_crc32, list_transform(range(9), lambda s: -1.0 / ln(
        (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s), 1, 13))::BIGINT + 0.5) / 4503599627370496)) AS score,
        floor((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || text_crc32 || ':slice'), 1, 13))::BIGINT + 0.5)
            / 4503599627370496 * 4096) AS slice
    FROM coded
),
best AS (
    SELECT *, list_position(score[1:8], list_max(score[1:8])) - 1 AS shard, score[9] > list_max(score[1:8]) AS moves FROM scored
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY slice, doc_id, size, text_crc32) - 1 AS slot,
    (CASE WHEN moves THEN 8 ELSE shard END)::INT AS grown_shard
FROM best"""
)


@register("op10_rendezvous_sharding", _RENDEZVOUS)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), "doc_id", "text")


_WARC = """
WITH hashed AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
),
spelled AS (
    SELECT page_id, payload_bytes, list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (5 * (3 - i % 4))::INT) & 31) + 1, 1)), lambda a, b: a || b) AS payload_digest
    FROM hashed
),
kept AS (SELECT payload_digest, max(page_id) AS keeper FROM spelled GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
    CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> keeper THEN keeper END AS refers_to, 1 AS requests, 1 AS metadata
FROM spelled JOIN kept USING (payload_digest)
"""


@register("op5_warc_transactions", _WARC)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_records(spark, path))
    head = F.col("head")
    return captures.filter(head.isNotNull()).select(
        head["headers"]["x-page-id"].cast("long").alias("page_id"),
        head["payload_bytes"].alias("payload_bytes"),
        head["payload_digest"].alias("payload_digest"),
        head["record_type"].alias("record_type"),
        F.regexp_extract(head["refers_to"], "^<urn:capture:(-?[0-9]+):", 1).cast("long").alias("refers_to"),
        F.size("requests").alias("requests"),
        F.size("metadata").alias("metadata"),
    )


def tokenizer_file() -> str:
    """Place of the public byte-level vocabulary; the operator takes any file of its kind."""
    return public_tokenizers.path("byte_bpe_50k.json")


@register("op4_bpe_transducer")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file())


@register("op8_simhash_vptree")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op7_template_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TOP = """
WITH kept AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM kept q JOIN kept c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


@register("op9_mtree_topk", _TOP)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


@register("op2_language_spans")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(fold("doc_id", 5) != 0))
    found = langid.identify(docs, model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", F.size("spans").alias("spans"))


@register("op6_rule_ensemble")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = stage(ruleset.statistics(table(spark, sf_dir, "documents"), "doc_id", "text"))
    labels = ruleset.one_label(table(spark, sf_dir, "labels"), "doc_id", "quality").filter(fold("doc_id", 5) != 0)
    ensemble = ruleset.fit(measured.join(labels, "doc_id"))
    scored = ruleset.score(measured, ensemble)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@register("op1_chained_passages")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


@register("op3_pitman_yor")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = pitmanyor.train(docs.filter(fold("doc_id", 7) != 2))
    found = pitmanyor.score(docs, model, keep={"held_out": fold("doc_id", 7) == 2})
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


#: Every document's failing filters as a bit mask; a prefix removes the masks it meets.
_AUDIT = r"""
WITH body AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
measured AS (
    SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals,
        min(doc_id) OVER (PARTITION BY t) AS first
    FROM body
),
failed AS (
    SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * capitals > 5 * length(t),
        regexp_matches(t, '[#$%&*|]'), coalesce(first < doc_id, false)] AS f
    FROM measured
),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
classes AS (
    SELECT part, list_sum(list_transform(range(5), lambda i: CASE WHEN f[i + 1] THEN 1 << i::INT ELSE 0 END))::INT AS mask,
        count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM failed LEFT JOIN marks USING (doc_id) GROUP BY 1, 2
),
letter AS (SELECT i::INT AS i, substr('ABCDE', i::INT + 1, 1) AS c FROM range(5) t(i)),
orders AS (
    SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letter a, letter b, letter c, letter d, letter e
    WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
),
steps AS (
    SELECT filter_order, s::INT AS step, substr(filter_order, s::INT, 1) AS filter,
        list_sum(list_transform(range(1, 6), lambda k: CASE WHEN k < s THEN 1 << (instr('ABCDE', substr(filter_order, k::INT, 1)) - 1)::INT ELSE 0 END))::INT AS before,
        (1 << (instr('ABCDE', substr(filter_order, s::INT, 1)) - 1)::INT) AS own
    FROM orders, range(1, 6) t(s)
),
counted AS (
    SELECT part, filter_order, step, filter,
        sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & before > 0 AND mask & own > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM classes, steps GROUP BY ALL
)
SELECT part, filter_order, step, filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM counted
"""


@register("op11_filter_audit", _AUDIT)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op12_bottom_k_fingerprints")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@register("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    h, n = fold("doc_id", 2**32), F.size(decontaminate.words_of(F.col("text"))).cast("long")
    g = F.floor(h / 10)
    repeats = (h % 10 == 0) & (n > 0)  # only these texts are split here
    a = F.when(repeats, g % n)
    period = F.when(repeats, 1 + F.floor((n - g % n) / (3 + g % 8)))
    found = periodic.detect(docs, again=(a, period))
    return found.drop("runs")

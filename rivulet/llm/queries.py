"""Queries opN_<name> over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import decontaminate, exact_dedup, language_id, line_dedup, mixing, quality, secrets, simhash, token_counts, warc
from rivulet.llm.common import Query, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.col("line_dedup.text").cast("binary"), 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source", "source_size", "target", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = language_id.held_out("doc_id", 4, 2)
    model = language_id.fit(docs.where(F.col("doc_id").isNotNull() & ~apart), "doc_id", "text", "lang")
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", apart.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.ambiguous")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, stats = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = quality.score(stats, model)
    return scored.select(F.col("id").alias("doc_id"), language_id.held_out("id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = secrets.train(secrets.labelled_samples(spark).union(secrets.corpus_samples(docs)))
    got = secrets.scan(docs, model)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return got.select("doc_id", *counts, F.sha2(secrets.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("all")).alias("spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), out="d")
    return got.select(
        "doc_id", "d.n_words", "d.n_hit", F.size("d.items").cast("long").alias("n_items"), decontaminate.items_digest(F.col("d.items")).alias("items_sha256"), (F.col("d.n_hit") > 0).alias("contaminated")
    )


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, n, string_split(coalesce(text, ''), chr(10))[n] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS n FROM documents)),
keyed AS (
  SELECT doc_id, n, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
repeated AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (
  SELECT k.doc_id, k.n, k.line, r.key IS NOT NULL AND r.owner <> k.doc_id AS dropped FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
g AS (SELECT payload, max(page_id) AS keeper FROM p GROUP BY payload),
d AS (SELECT p.page_id, octet_length(p.payload)::BIGINT AS payload_bytes, sha1(p.payload) AS h, g.keeper FROM p JOIN g ON p.payload = g.payload)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM d
"""

OP7_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""

WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP10_SQL = f"""
WITH dw AS (SELECT doc_id, {WORDS} AS w FROM documents),
bw AS (SELECT item_id, {WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
own AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
occ AS (SELECT own.doc_id, own.i, own.size, win.item_id FROM own JOIN win ON own.win = win.win AND own.size = win.size),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM occ) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(item.n, 0)::BIGINT AS n_items, sha256(coalesce(item.items, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN item ON dw.doc_id = item.doc_id
"""

ORACLES: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op2_warc": OP2_SQL, "op7_exact_dedup": OP7_SQL, "op10_decontamination": OP10_SQL}

QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc": op2_warc,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_language_id": op6_language_id,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_decontamination": op10_decontamination,
}

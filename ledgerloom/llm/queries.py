"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation, decontaminate, embedding_dups, exact_dedup, html_main, license_scan, mixing, ngram_join, pii, spelling, substring, toxicity, warc
from .oracles import CONVERSATION_SQL, EMBEDDING_SQL, SPELLING_SQL

#: Target share of characters per source of the mixing query; SQL below holds the same numbers.
MIX_WEIGHTS = {f"src{i}": float(1 + i % 4) for i in range(20)}
MIX_SEED = "mix"
#: Key of the registered query; a deployment passes its own secret.
PII_KEY = "demonstration key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "item_words", "matched_words", "coverage", F.size("tiles").alias("n_tiles"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.round_trip(table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)
    return got.select("doc_id", "text", "found", "pseudonyms")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"), batches=2)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.poisson_mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SEED)
    return mixed.select("doc_id", "source", "copy", "shuffle_key", "text")


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = html_main.main_text(table(spark, sf_dir, "pages"))
    return got.withColumn("n_chars", F.char_length("text").cast("long"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_warc": op2_warc,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_pii_pseudonyms": op5_pii_pseudonyms,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_toxicity": op8_toxicity,
    "op9_poisson_mix": op9_poisson_mix,
    "op10_html_main_text": op10_html_main_text,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_embedding_dups": op13_embedding_dups,
}

ORACLE: dict[str, str] = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), d AS (
            SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p
        ), f AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id < page_id THEN first_id END AS refers_to
        FROM f
    """,
    "op6_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
            FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    "op9_poisson_mix": """
        WITH RECURSIVE w(source, weight) AS (
            SELECT 'src' || i, 1.0::DOUBLE + i % 4 FROM range(20) t(i)
        ), v AS (
            SELECT w.source, w.weight, sum(length(d.text))::BIGINT AS volume
            FROM documents d JOIN w USING (source) GROUP BY 1, 2
        ), r AS (
            SELECT source, (weight / sum(weight) OVER ()) * sum(volume) OVER () / volume AS rate FROM v
        ), c(source, rate, k, p, cdf) AS (
            SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
            UNION ALL
            SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM c WHERE k < rate + 60
        ), u AS (
            SELECT doc_id, source, text, ('0x' || substr(md5('mix|' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS at FROM documents
        ), n AS (
            SELECT u.doc_id, count(*) AS copies FROM u JOIN c ON u.source = c.source AND c.cdf <= u.at GROUP BY 1
        )
        SELECT u.doc_id, u.source, k.copy::INTEGER AS copy, md5('mix-order|' || u.doc_id || '|' || k.copy) AS shuffle_key, u.text
        FROM u JOIN n USING (doc_id) JOIN (SELECT unnest(range(1, 200)) AS copy) k ON k.copy <= n.copies
    """,
    "op11_conversation_repair": CONVERSATION_SQL,
    "op12_spelling_variants": SPELLING_SQL,
    "op13_embedding_dups": EMBEDDING_SQL,
}

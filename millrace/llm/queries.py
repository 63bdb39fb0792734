"""The thin queries of the corpus operators over the driver's tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import fingerprints, jpeg_media, mixing, near_dup, packing, pii, pitman_yor, quality, token_counts, warc
from millrace.llm.common import fold_column, table


def op1_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op2_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.rewritten(table(spark, sf_dir, "pages"), least=1000).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), packing.Limits(tokens=2048))


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold_column("doc_id", 5) == 1
    found = pitman_yor.scored(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUALITY_LEAST = 0.7


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold_column("doc_id", 4) == 2
    found = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op8_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"), k=64)


def op9_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_media.media(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), near_dup.Forest(shingle=4, percent=80))


QUERIES = {f.__name__: f for f in (op1_weak_pii, op2_raked_mixture, op3_warc_revisits, op4_best_fit_packing, op5_pitman_yor, op6_quality, op7_token_counts, op8_bottom_k, op9_jpeg_media, op10_minhash_near_dedup)}

ORACLE_SQL: dict[str, str] = {
    "op2_raked_mixture": mixing.sql(),
    "op3_warc_revisits": """
        with payloads as (select page_id, coalesce(html, '') as payload from pages),
        digests as (select page_id, strlen(payload) as payload_bytes, sha1(payload) as payload_digest from payloads),
        lasts as (select *, max(page_id) over (partition by payload_digest) as last_id from digests)
        select page_id, payload_bytes, payload_digest,
            case when payload_bytes >= 1000 and page_id is distinct from last_id then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= 1000 and page_id is distinct from last_id then last_id end as refers_to
        from lasts""",
}

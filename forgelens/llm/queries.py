"""One query for each operator, over whole tables with production parameters, and comparison SQL where there is any."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from forgelens.llm import decontamination, language_model, license_scan, minhash_dedup, oracle_sql, secret_scan, sentencepiece_codec, simhash_dedup, spelling_variants, substring_dedup, suffix_dedup, token_alignment, topk_search, toxicity

#: Paths of the published vocabulary files, read on the driver.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
BYTE_MODEL = os.environ.get("BYTE_MODEL", "/opt/tokenizers/byte_bpe_50k.json")


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def op1_license_scan(spark: SparkSession, directory: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, directory, "documents"))


def op2_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, directory, "documents"), _table(spark, directory, "benchmark"))


def op3_secret_scan(spark: SparkSession, directory: str) -> DataFrame:
    found = secret_scan.scan_secrets(_table(spark, directory, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans")


def op4_minhash_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, directory, "documents"))


def op5_substring_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return substring_dedup.remove_repeated_words(_table(spark, directory, "documents"), with_text=False)


def op6_topk_search(spark: SparkSession, directory: str) -> DataFrame:
    return topk_search.top_k(_table(spark, directory, "embeddings"), 50)


def op7_suffix_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return suffix_dedup.remove_earlier_bytes(_table(spark, directory, "documents"), with_bytes=False)


def op8_sentencepiece(spark: SparkSession, directory: str) -> DataFrame:
    return sentencepiece_codec.encode(_table(spark, directory, "documents"), PIECE_MODEL)


def op9_language_model(spark: SparkSession, directory: str) -> DataFrame:
    return language_model.score_documents(_table(spark, directory, "documents"), PIECE_MODEL)


def op10_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    documents = _table(spark, directory, "documents")
    return toxicity.score_toxicity(documents, toxicity.train(documents, _table(spark, directory, "labels")))


def op11_simhash_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, directory, "documents"))


def op12_token_alignment(spark: SparkSession, directory: str) -> DataFrame:
    return token_alignment.align_documents(_table(spark, directory, "documents"), BYTE_MODEL, PIECE_MODEL)


def op13_spelling_variants(spark: SparkSession, directory: str) -> DataFrame:
    return spelling_variants.spelling_variants(_table(spark, directory, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_decontamination,
        op3_secret_scan,
        op4_minhash_dedup,
        op5_substring_dedup,
        op6_topk_search,
        op7_suffix_dedup,
        op8_sentencepiece,
        op9_language_model,
        op10_toxicity,
        op11_simhash_dedup,
        op12_token_alignment,
        op13_spelling_variants,
    )
}

_FINITE = "vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"

ORACLE_SQL: dict[str, str] = {
    "op4_minhash_dedup": oracle_sql.MINHASH_DEDUP,
    "op5_substring_dedup": oracle_sql.SUBSTRING_DEDUP,
    "op7_suffix_dedup": oracle_sql.SUFFIX_DEDUP,
    "op13_spelling_variants": oracle_sql.SPELLING_VARIANTS,
    "op6_topk_search": f"""
        WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS ints FROM embeddings WHERE {_FINITE}),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.ints, c.ints) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ),
        placed AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
        SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 5
    """,
}

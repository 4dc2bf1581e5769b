"""Queries of this subpackage over the test tables, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import (
    bpe,
    fill_middle,
    katz,
    mixing,
    neighbours,
    periodic_runs,
    pii,
    quality,
    secrets,
    set_join,
    token_counts,
    url_filter,
    vector_dedup,
)

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(_read(spark, sf_dir, "documents"))


def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(_read(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"), k=10)


def op3_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_source(_read(spark, sf_dir, "documents"))


def op4_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op5_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode_digests(_read(spark, sf_dir, "documents"), VOCABULARY)


def op7_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_read(spark, sf_dir, "documents"))


def op8_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = set_join.group_documents(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(_read(spark, sf_dir, "documents"))


def op10_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_in_middle(_read(spark, sf_dir, "documents")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = periodic_runs.with_planted_repeats(_read(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.find_runs(documents))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(_read(spark, sf_dir, "documents")))


QUERIES = {
    "op1_katz": op1_katz,
    "op2_learned_partitions": op2_learned_partitions,
    "op3_flow_mix": op3_flow_mix,
    "op4_projection_passes": op4_projection_passes,
    "op5_url_trees": op5_url_trees,
    "op6_bpe": op6_bpe,
    "op7_skip_chain_pii": op7_skip_chain_pii,
    "op8_set_join": op8_set_join,
    "op9_token_counts": op9_token_counts,
    "op10_importance": op10_importance,
    "op11_fill_middle": op11_fill_middle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_secrets": op13_secrets,
}

ORACLES = {
    "op9_token_counts": r"""
SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
FROM documents""",
    "op11_fill_middle": r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
        sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash FROM documents),
numbers AS (
    SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || hash[1:8] AS BIGINT) AS h1, CAST('0x' || hash[9:16] AS BIGINT) AS h2,
        CAST('0x' || hash[17:24] AS BIGINT) AS h3, CAST('0x' || hash[25:32] AS BIGINT) AS h4 FROM units),
cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
        CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers),
parts AS (
    SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
        array_to_string(units[high + 1:], '') AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts""",
}

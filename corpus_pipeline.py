"""The corpus pipeline: from raw documents to token ids.

Each stage takes the documents its predecessor kept, is written to the shared folder and read again. All
stages but the last return the columns of ``documents``; every column a table has is carried along.

Documents without an id keep their place in every stage; a group of copies keeps the row with the
smallest id. Of rows equal in id those count whose set of shingles has the smallest hash, and of these the
row with the smallest text, then the smallest other columns. Columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.staging import stage
from newsloom.llm import bpe, mixing, pii, quality, set_join

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are unlike those labelled good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.select(docs, labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return set_join.keep_one_per_group(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts and count their characters anew."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring the sources to their target weights; a document that is used again is a row again."""
    return mixing.apply_mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document, as their number and digests of ids and of the decoded text."""
    return bpe.encode_decode_digests(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("source_mix", mix_sources),
    ("bpe", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs


# Gumbel sampling on fitted weights and the random field are not expressible in SQL.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}

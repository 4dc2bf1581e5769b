"""An inverted index kept as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import surface_tokens

# Ids per posting block. A block is the largest group one task ever collects.
BLOCK_IDS = 1 << 16


def lower_tokens(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def with_surface_tokens(documents: DataFrame) -> DataFrame:
    return documents.select("id", surface_tokens(F.col("text")).alias("tokens"))


def latest_documents(documents: DataFrame, batch: str = "batch") -> DataFrame:
    """One row per id, from its last batch; ids are unique within a batch.

    The last batches are found on two narrow columns and summed up before they move, so an
    id that was indexed very often costs no more than others. The texts are shuffled once,
    by a join that adaptive execution splits where an id is hot.
    """
    last = documents.groupBy("id").agg(F.max(batch).alias(batch))
    return documents.join(last, ["id", batch], "left_semi").drop(batch)


def index_documents(
    documents: DataFrame,
    preprocess_tokens: bool = False,
    preprocessor: Callable[[Column], Column] = lower_tokens,
) -> DataFrame:
    """``(token, id)`` pairs of documents with distinct ids, such as ``latest_documents``.

    Repeats are dropped inside each document, which needs no shuffle. ``preprocessor`` maps
    the array of tokens to the second set of forms that are indexed too.
    """
    tokens = with_surface_tokens(documents)
    forms = F.array_distinct("tokens")
    if preprocess_tokens:
        forms = F.array_union("tokens", preprocessor(F.col("tokens")))
    # An inner explode would test the forms for emptiness first, and so tokenise twice.
    return tokens.select(F.explode_outer(forms).alias("token"), "id").where("token is not null")


def add_to_index(postings: DataFrame, documents: DataFrame, **options) -> DataFrame:
    """Postings after indexing ``documents``; the old postings of a re-indexed id are dropped."""
    kept = postings.join(documents.select("id"), "id", "left_anti")
    return kept.select("token", "id").unionByName(index_documents(documents, **options))


def write_index(postings: DataFrame, path: str) -> None:
    """Ranges of (token, id): a query reads few row groups and a hot token spans many files."""
    postings.repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").parquet(path)


def query_index(postings: DataFrame, term: str) -> DataFrame:
    """Ids of exactly this term; an unknown term has none."""
    return postings.where(F.col("token") == term).select("id")


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"))


def posting_blocks(postings: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Posting lists cut by ranges of ids: ``(token, block, ids, n_docs)``, ids in order.

    A token may occur in a third of all documents, so its whole list is never one row.
    """
    block = F.expr(f"(id - pmod(id, {block_ids}L)) div {block_ids}L")
    return (
        postings.groupBy("token", block.alias("block"))
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("n_docs", F.size("ids").cast("long"))
    )

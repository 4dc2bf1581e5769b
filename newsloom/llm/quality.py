"""Quality by importance resampling: a ratio of hashed n-gram models, sampled by Gumbel top-k.

Two generative models are counted over hashed features: one over target documents (labelled good), one
over the raw documents. The log importance weight of a document is the sum over its features of the log
ratio of the two. Adding Gumbel noise and keeping the k largest sums draws k documents without
replacement in proportion to their weights.

Features are the words, the shapes of words and the pairs of neighbouring shapes. The shape of a word
has one letter per run of characters of a kind (lower case, upper case, digits, other letters, each
punctuation mark); a word that repeats the one before it has a shape of its own.

The raw model counts every document. The target model is fitted on at most ``max_targets`` labelled
documents, those whose ids come first in the order of a hash; it leans on the raw model where it has few
counts, so that words it has not met weigh little.

A null or empty text has no features and weight 0 (log scale). Rows with equal ids get equal noise. All
rows that tie with the k-th are kept. Without target documents all weights are equal. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.staging import stage
from newsloom.llm.text import LOWER, batch_bytes, hash_spans, mix, pieces, word_bounds

WORD_BUCKETS = 1 << 16
SHAPE_BUCKETS = 1 << 12
PAIR_BUCKETS = 1 << 14
FAMILIES = (WORD_BUCKETS, SHAPE_BUCKETS, PAIR_BUCKETS)
STARTS = tuple(int(x) for x in np.cumsum((0, *FAMILIES)))
MAX_TARGETS = 20_000
# Features of the raw model that are added to the target counts, per bucket of a family.
PRIOR = 10.0
# By default as many documents are kept as have this log weight or more.
LEAST_LOG_WEIGHT = -2.0
SEED = 1
BINS = 4096
# Texts whose features are held at once; they need about thirty times as much.
PIECE_BYTES = 1 << 20

KINDS = np.arange(256, dtype=np.uint8)
KINDS[ord("a") : ord("z") + 1] = ord("a")
KINDS[ord("A") : ord("Z") + 1] = ord("A")
KINDS[ord("0") : ord("9") + 1] = ord("0")
KINDS[128:] = 128


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, three per word, and the row of each."""
    data, offsets = batch_bytes(texts)
    starts, ends = word_bounds(data, offsets)
    rows = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
    of_words = hash_spans(LOWER[data], starts, ends)
    first = np.ones(len(starts), dtype=bool)
    first[1:] = rows[1:] != rows[:-1]
    kinds = KINDS[data]
    kept = np.ones(len(data), dtype=bool)
    kept[1:] = kinds[1:] != kinds[:-1]
    kept[starts] = True
    at = np.zeros(len(data) + 1, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum(kept, out=at[1:])
    shapes = hash_spans(kinds[kept], at[starts], at[ends])
    again = np.zeros(len(starts), dtype=bool)
    again[1:] = (of_words[1:] == of_words[:-1]) & ~first[1:]
    shapes[again] = 0
    left = np.ones(len(starts), dtype=np.uint64)
    left[1:] = np.where(first[1:], 1, shapes[:-1])
    pairs = mix(left, 5) ^ shapes
    numbers = [
        (mix(h, 9) % np.uint64(size)).astype(np.int64) + start
        for h, size, start in zip((of_words, shapes, pairs), FAMILIES, STARTS, strict=False)
    ]
    return np.concatenate(numbers), np.concatenate([rows] * 3)


def _log_weights(texts: pa.Array, ratios: np.ndarray) -> np.ndarray:
    numbers, rows = features(texts)
    return np.bincount(rows, weights=ratios[numbers], minlength=len(texts))


def target_ids(labels: DataFrame, max_targets: int = MAX_TARGETS) -> np.ndarray:
    """Ids of at most ``max_targets`` good documents: quality 1 and not toxic."""
    good = labels.where("quality = 1 and not coalesce(toxic, 0) = 1 and doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id")
    )
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_targets).toPandas()
    return np.unique(chosen["doc_id"].to_numpy(dtype=np.int64))


def _ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )


def fit(docs: DataFrame, labels: DataFrame, max_targets: int = MAX_TARGETS) -> np.ndarray:
    """The log ratio of target to raw probability of every feature."""
    spark = docs.sparkSession
    targets = spark.sparkContext.broadcast(target_ids(labels, max_targets))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.zeros(STARTS[-1], dtype=np.int64)
        target = np.zeros(STARTS[-1], dtype=np.int64)
        for batch in pieces(batches, 1, PIECE_BYTES):
            numbers, rows = features(batch.column(1))
            ids = batch.column(0).fill_null(-1).to_numpy()
            is_target = np.isin(ids, targets.value) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            raw += np.bincount(numbers, minlength=len(raw))
            target += np.bincount(numbers[is_target[rows]], minlength=len(raw))
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], names=["feature", "raw", "target"]
        )

    counts = (
        _ids_and_texts(docs)
        .mapInArrow(count, "feature long, raw long, target long")
        .groupBy("feature")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toPandas()
    )
    ratios = np.zeros(STARTS[-1])
    tables = np.zeros((2, STARTS[-1]))
    tables[0, counts["feature"]] = counts["raw"]
    tables[1, counts["feature"]] = counts["target"]
    if not tables[1].any():
        return ratios
    for start, size in zip(STARTS, FAMILIES, strict=False):
        part = slice(start, start + size)
        raw = (tables[0, part] + 1) / (tables[0, part].sum() + size)
        target = (tables[1, part] + PRIOR * size * raw) / (tables[1, part].sum() + PRIOR * size)
        ratios[part] = np.log(target) - np.log(raw)
    return ratios


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel noise, a function of the id and the seed."""
    uniform = ((mix(ids.astype(np.uint64), seed) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(uniform))


def weigh(docs: DataFrame, ratios: np.ndarray, seed: int = SEED) -> DataFrame:
    """``(doc_id, log_weight, key)``; key is the log weight with noise."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, PIECE_BYTES):
            weights = _log_weights(batch.column(1), sent.value)
            keys = weights + gumbel(batch.column(0).fill_null(-1).to_numpy(), seed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(weights), pa.array(keys)], names=["doc_id", "log_weight", "key"]
            )

    return _ids_and_texts(docs).mapInArrow(score, "doc_id long, log_weight double, key double")


def kth_largest(frame: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, found by counting bins and then within the bin that holds it."""
    if k <= 0:
        return math.inf
    value = F.col(column)
    low, high = frame.agg(F.min(value), F.max(value)).first()
    if low is None:
        return -math.inf
    while low < high:
        width = (high - low) / BINS
        bin_of = F.least(F.floor((value - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        bins = (
            frame.where(value.between(low, high))
            .groupBy(bin_of.alias("bin"))
            .agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
            .toPandas()
            .sort_values("bin", ascending=False)
        )
        passed = bins["n"].cumsum().to_numpy()
        if k > passed[-1]:
            return low
        at = int(np.searchsorted(passed, k))
        k -= int(passed[at - 1]) if at else 0
        if len(bins) == 1 and (bins["low"].iloc[0], bins["high"].iloc[0]) == (low, high):
            return low
        low, high = float(bins["low"].iloc[at]), float(bins["high"].iloc[at])
    return low


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, max_targets: int = MAX_TARGETS, seed: int = SEED) -> DataFrame:
    """``(doc_id, log_weight, key, kept)`` per document.

    ``k`` is how many to keep. By default it is the number of documents that the target model explains
    about as well as the raw one (``LEAST_LOG_WEIGHT`` or more), so that the sample drops what is
    unlike the target and keeps the rest.
    """
    weighed, least = _sample(docs, fit(docs, labels, max_targets), k, seed)
    return weighed.withColumn("kept", F.col("key") >= F.lit(least))


def _sample(docs: DataFrame, ratios: np.ndarray, k: int | None, seed: int) -> tuple[DataFrame, float]:
    """The weights of all documents and the least key that is kept."""
    weighed = stage(weigh(docs, ratios, seed), "weights")
    if k is None:
        k = weighed.where(F.col("log_weight") >= LEAST_LOG_WEIGHT).count()
    return weighed, kth_largest(weighed, "key", k)


def select(docs: DataFrame, labels: DataFrame, k: int | None = None, max_targets: int = MAX_TARGETS, seed: int = SEED) -> DataFrame:
    """The documents kept, with their columns; a row without id is judged with the noise of id -1."""
    ratios = fit(docs, labels, max_targets)
    weighed, least = _sample(docs, ratios, k, seed)
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, names.index("text"), PIECE_BYTES):
            ids = batch.column(names.index("doc_id")).cast(pa.int64()).fill_null(-1).to_numpy()
            keys = _log_weights(batch.column(names.index("text")), sent.value) + gumbel(ids, seed)
            yield batch.filter(pa.array(keys >= least))

    return docs.mapInArrow(keep, docs.schema)

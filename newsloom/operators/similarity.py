"""Similarity of topics, by shared articles, by words and by both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.operators.articles import top_rows

METRICS = ("doc_sim", "word_sim", "jaccard", "word_doc_sim")
DEFAULT_METRIC = "word_doc_sim"
JACCARD_MIN_PROB = 0.15
THRESHOLD_PERCENTILE = 85
COMMON_SHARE = 0.2
# Similarities are rounded before they are compared with a percentile of themselves, so
# that the order in which a cluster adds numbers up cannot move a cell across the bound.
SIMILARITY_DIGITS = 12
# Topics on a side of a tile of a matrix, tiles that are added up at a time, and levels of sums below the
# root: enough for FAN_IN ** 3 tasks.
TILE = 128
FAN_IN = 64
LEVELS = 2


def _tiles(dots: np.ndarray, both: np.ndarray, part: int) -> pa.RecordBatch:
    """The upper half of two symmetric matrices as a row per square tile."""
    cuts = range(0, len(dots), TILE)
    places = [(a, b) for a in cuts for b in cuts if a <= b]
    cut = lambda m: [np.ascontiguousarray(m[a : a + TILE, b : b + TILE]).tobytes() for a, b in places]
    columns = [
        pa.array([a for a, _ in places], pa.int32()),
        pa.array([b for _, b in places], pa.int32()),
        pa.array([part] * len(places), pa.int32()),
        pa.array([len(dots)] * len(places), pa.int32()),
        pa.array(cut(dots), pa.binary()),
        pa.array(cut(both.astype(np.int64)), pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "part", "size", "dots", "both"])


def _sum_of(tiles: pa.Table, name: str, kind: type) -> np.ndarray:
    """The tiles of a group added up in the order of their parts, so that sums can be repeated."""
    ordered = tiles.take(pc.sort_indices(tiles["part"]))[name].to_pylist()
    total = np.zeros(len(ordered[0]) // 8, dtype=kind)
    for tile in ordered:
        total += np.frombuffer(tile, dtype=kind)
    return total


def _added(tiles: pa.Table) -> pa.Table:
    """One tile instead of all of a group, for the next level of the tree."""
    first = tiles.slice(0, 1)
    sums = {name: _sum_of(tiles, name, kind).tobytes() for name, kind in (("dots", np.float64), ("both", np.int64))}
    out = {name: first[name] for name in ("a", "b", "part", "size")} | {name: pa.array([x], pa.binary()) for name, x in sums.items()}
    out["part"] = pa.array([tiles["part"][0].as_py() // FAN_IN], pa.int32())
    return pa.table(out)


def _cells_of(tiles: pa.Table) -> pa.Table:
    """``(i, j, dot, both)`` of the upper half from all parts of a tile."""
    a, b, size = (tiles[name][0].as_py() for name in ("a", "b", "size"))
    shape = (min(TILE, size - a), min(TILE, size - b))
    i, j = np.indices(shape)
    kept = i + a <= j + b
    dots, both = (_sum_of(tiles, name, kind).reshape(shape)[kept] for name, kind in (("dots", np.float64), ("both", np.int64)))
    return pa.table({"i": pa.array((i[kept] + a).astype(np.int32)), "j": pa.array((j[kept] + b).astype(np.int32)), "dot": dots, "both": both})


def gram_cells(vectors: DataFrame, column: str, threshold: float = JACCARD_MIN_PROB) -> DataFrame:
    """``(i, j, dot, both)`` for topics ``i <= j``, from one row of topic weights per article.

    ``dot`` is the sum of products and ``both`` the number of rows above ``threshold`` in both topics. Each
    task multiplies its rows as matrices and emits one row per tile of ``TILE`` by ``TILE`` topics, however
    many articles it reads. Tiles are added up as a tree, ``FAN_IN`` at a time, so no task holds more than
    these; single cells appear at its root only.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dots, both = None, None
        for batch in batches:
            rows = batch.num_rows
            if rows == 0:
                continue
            weights = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
            above = (weights > threshold).astype(np.float64)
            if dots is None:
                dots = np.zeros((weights.shape[1],) * 2)
                both = np.zeros_like(dots)
            dots += weights.T @ weights
            both += above.T @ above
        if dots is not None:
            yield _tiles(dots, both, TaskContext.get().partitionId())

    fields = "a int, b int, part int, size int, dots binary, both binary"
    tiles = vectors.select(column).where(F.col(column).isNotNull()).mapInArrow(partial, fields)
    for _ in range(LEVELS):
        tiles = tiles.groupBy("a", "b", F.expr(f"part div {FAN_IN}")).applyInArrow(_added, fields)
    return tiles.groupBy("a", "b").applyInArrow(_cells_of, "i int, j int, dot double, both bigint")


def _mirrored(cells: DataFrame) -> DataFrame:
    """All cells of a symmetric matrix from its upper half; (i, j) and (j, i) are the same number."""
    values = [name for name in cells.columns if name not in ("i", "j")]
    both_ways = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    )
    return cells.select(F.inline(both_ways).alias("i", "j"), *values)


def _diagonal(value: str, side: str) -> Column:
    """The diagonal value of the row or column of a cell; the table has one row per pair of topics."""
    return F.max(F.when(F.col("i") == F.col("j"), F.col(value))).over(W.partitionBy(side))


def _cosine(dot: str) -> Column:
    size = F.sqrt(_diagonal(dot, "i")) * F.sqrt(_diagonal(dot, "j"))
    return F.round(F.coalesce(F.try_divide(F.col(dot), size), F.lit(0.0)), SIMILARITY_DIGITS)


def word_vectors(words: DataFrame, num_topics: int) -> DataFrame:
    """``(term, weights)``: one row per term with its weight in every topic."""
    entries = F.map_from_entries(F.collect_list(F.struct("topic_id", "weight")))
    topics = F.sequence(F.lit(0), F.lit(num_topics - 1))
    return (
        words.groupBy("term")
        .agg(entries.alias("by_topic"))
        .select("term", F.transform(topics, lambda t: F.coalesce(F.try_element_at("by_topic", t), F.lit(0.0))).alias("weights"))
    )


def topic_similarities(
    vectors: DataFrame,
    words: DataFrame,
    num_topics: int,
    jaccard_threshold: float = JACCARD_MIN_PROB,
) -> DataFrame:
    """``(i, j, doc_sim, word_sim, jaccard, word_doc_sim)`` with all pairs of topics.

    The articles are read once for both article-based measures.
    """
    by_doc = _mirrored(gram_cells(vectors, "shares", jaccard_threshold)).select(
        "i",
        "j",
        _cosine("dot").alias("doc_sim"),
        F.round(
            F.try_divide(F.col("both"), _diagonal("both", "i") + _diagonal("both", "j") - F.col("both")),
            SIMILARITY_DIGITS,
        ).alias("jaccard"),
    )
    by_word = _mirrored(gram_cells(word_vectors(words, num_topics), "weights")).select(
        "i", "j", _cosine("dot").alias("word_sim")
    )
    off_diagonal = F.col("i") != F.col("j")
    whole = W.partitionBy(F.lit(0))  # one row per pair of topics
    doc = F.when(off_diagonal, F.col("doc_sim")).otherwise(0.0)
    word = F.when(off_diagonal, F.col("word_sim")).otherwise(0.0)
    scale = F.try_divide(F.max(doc).over(whole), F.max(word).over(whole))
    return by_doc.join(by_word, ["i", "j"]).select(
        "i",
        "j",
        "doc_sim",
        "word_sim",
        "jaccard",
        F.round((scale * word + doc) / 2.0, SIMILARITY_DIGITS).alias("word_doc_sim"),
    )


def similarity_matrix(
    similarities: DataFrame, metric: str = DEFAULT_METRIC, zero_self_similarity: bool = False
) -> DataFrame:
    """``(i, j, sim)`` of one metric."""
    if metric not in METRICS:
        raise ValueError(f"unknown similarity metric {metric!r}; choose one of {', '.join(METRICS)}")
    sim = F.col(metric)
    if zero_self_similarity:
        sim = F.when(F.col("i") == F.col("j"), 0.0).otherwise(sim)
    return similarities.select("i", "j", sim.alias("sim"))


def similar_topics(
    similarities: DataFrame,
    topic_id: int,
    top_n: int | None = 10,
    min_similarity: float = 0.0,
    metric: str = DEFAULT_METRIC,
) -> DataFrame:
    """``(topic_id, sim)`` of the topics most similar to one topic, which is itself left out."""
    others = similarity_matrix(similarities, metric).where(
        (F.col("i") == topic_id) & (F.col("j") != topic_id) & (F.col("sim") >= min_similarity)
    )
    return top_rows(others.select(F.col("j").alias("topic_id"), "sim"), [F.desc("sim"), F.asc("topic_id")], top_n)


def similar_pairs(similarities: DataFrame, top_n: int | None = 20, metric: str = DEFAULT_METRIC) -> DataFrame:
    """``(i, j, sim)`` with ``i > j``: the most similar pairs of topics, each once."""
    pairs = similarity_matrix(similarities, metric).where(F.col("i") > F.col("j"))
    return top_rows(pairs, [F.desc_nulls_last("sim"), F.asc("i"), F.asc("j")], top_n)


def _threshold(matrix: DataFrame, percentile: float) -> Column:
    """The percentile of all cells as a scalar; a cell per pair of topics, so one task holds them."""
    return matrix.agg(F.percentile("sim", F.lit(percentile / 100.0))).scalar()


def common_topics(
    similarities: DataFrame,
    num_topics: int,
    metric: str = DEFAULT_METRIC,
    top_n: int | None = 10,
    similar_to: float = COMMON_SHARE,
    threshold_percentile: float = THRESHOLD_PERCENTILE,
) -> DataFrame:
    """``(topic_id, n_similar)`` of topics similar to a large part of all topics, most first."""
    matrix = similarity_matrix(similarities, metric, zero_self_similarity=True)
    counted = (
        matrix.withColumn("over", F.col("sim") >= _threshold(matrix, threshold_percentile))
        .groupBy(F.col("i").alias("topic_id"))
        .agg(F.count_if("over").alias("n_similar"))
        .where(F.col("n_similar") >= similar_to * num_topics)
    )
    return top_rows(counted, [F.desc("n_similar"), F.asc("topic_id")], top_n)


def standalone_topics(
    similarities: DataFrame,
    metric: str = DEFAULT_METRIC,
    top_n: int | None = None,
    threshold_percentile: float = THRESHOLD_PERCENTILE,
) -> DataFrame:
    """``(topic_id)`` of topics with no cell above the percentile."""
    matrix = similarity_matrix(similarities, metric, zero_self_similarity=True)
    alone = (
        matrix.withColumn("under", F.col("sim") <= _threshold(matrix, threshold_percentile))
        .groupBy(F.col("i").alias("topic_id"))
        .agg(F.every("under").alias("alone"))
        .where("alone")
        .select("topic_id")
    )
    return top_rows(alone, [F.asc("topic_id")], top_n)


def threshold_matrix(matrix: DataFrame, threshold_percentile: float | None) -> DataFrame:
    """Cells at or below the percentile, and NULL ones, become zero; no percentile, no change."""
    if not threshold_percentile:
        return matrix
    high = F.col("sim") > _threshold(matrix, threshold_percentile)
    return matrix.withColumn("sim", F.when(high, F.col("sim")).otherwise(0.0))


def heat_map(
    similarities: DataFrame,
    metric: str = DEFAULT_METRIC,
    threshold_percentile: float | None = THRESHOLD_PERCENTILE,
) -> DataFrame:
    return threshold_matrix(
        similarity_matrix(similarities, metric, zero_self_similarity=True), threshold_percentile
    )

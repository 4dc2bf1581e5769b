"""Approximate nearest neighbours by learned partitions.

Fitting uses a bounded sample, the ``SAMPLE`` vectors that come first in the order of a hash: their exact
neighbour graph is cut into balanced partitions with few cut edges, and a small classifier learns to
tell the partitions of a point's neighbours from the point. Every vector is then indexed in its most
probable partition. A query is routed to its most probable partitions, as many as find ``RECALL`` of the
neighbours of held-out sample points, and all vectors there are ranked by their exact distance.

Partitions grow in number with the table up to ``MAX_PARTITIONS``. Large partitions are searched in
blocks of about ``BLOCK`` vectors, so that no task holds one partition.

Vectors that are null, empty, all zero or hold null or non-finite components take no part, nor do rows
without id and vectors that are not as long as most. Rows equal in id and vector count once. A vector
does not find itself: candidates with the query's id are left out. Ties go to the smaller id. With fewer
candidates than asked for, all are returned. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions.staging import stage
from newsloom.llm.vectors import stack, valid_vectors

SAMPLE = 8192
HELD_OUT = 512
NEIGHBOURS = 10
PER_PARTITION = 1000
MAX_PARTITIONS = 256
SLACK = 1.1
HIDDEN = 128
EPOCHS = 30
RECALL = 0.96
BLOCK = 4096
SEED = 1


def nearest(points: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k nearest rows of ``among`` for each point, in any order."""
    out = []
    norms = (among**2).sum(axis=1)
    for low in range(0, len(points), 512):
        far = norms - 2 * points[low : low + 512] @ among.T
        # A copy, as a view would keep all columns.
        out.append(np.argpartition(far, k - 1, axis=1)[:, :k].copy())
    return np.concatenate(out)


def balanced_partition(points: np.ndarray, graph: np.ndarray, parts: int, seed: int = SEED, sweeps: int = 8) -> np.ndarray:
    """Cut a neighbour graph into parts of at most ``SLACK`` times the mean size with few cut edges.

    Starts from recursive halving along main directions; then points move to the part that most of
    their neighbours (in either direction) are in, while it has room.
    """
    part = np.zeros(len(points), dtype=np.int64)
    queue = [(np.arange(len(points)), 0, parts)]
    while queue:
        rows, first, n = queue.pop()
        if n == 1:
            part[rows] = first
            continue
        centred = points[rows] - points[rows].mean(axis=0)
        direction = np.random.default_rng([seed, first, n]).normal(size=points.shape[1])
        for _ in range(10):
            direction = centred.T @ (centred @ direction)
            direction /= np.linalg.norm(direction) or 1.0
        order = rows[np.argsort(centred @ direction, kind="stable")]
        cut = len(rows) * (n // 2) // n
        queue += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    edges = [[] for _ in range(len(points))]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            if i != j:
                edges[i].append(j)
                edges[j].append(i)
    room = int(np.ceil(SLACK * len(points) / parts))
    sizes = np.bincount(part, minlength=parts)
    rng = np.random.default_rng(seed)
    for _ in range(sweeps):
        moved = 0
        for i in rng.permutation(len(points)).tolist():
            if not edges[i]:
                continue
            votes = np.bincount(part[edges[i]], minlength=parts)
            votes[(sizes >= room) & (np.arange(parts) != part[i])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[part[i]] and sizes[part[i]] > 1:
                sizes[part[i]] -= 1
                sizes[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A classifier with one hidden layer, and how many partitions a query visits."""

    centre: np.ndarray
    scale: float
    layers: list[np.ndarray]
    probes: int

    @property
    def parts(self) -> int:
        return self.layers[-1].shape[0]

    def scores(self, points: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((points - self.centre) / self.scale @ w1 + b1, 0) @ w2 + b2

    def ranked(self, points: np.ndarray, n: int) -> np.ndarray:
        """The n most probable partitions of each point, most probable first."""
        return np.argsort(-self.scores(points), axis=1, kind="stable")[:, :n]


def train_router(points: np.ndarray, wanted: np.ndarray, seed: int = SEED) -> Router:
    """Fit to the distribution of partitions ``wanted`` by Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    dim, parts = points.shape[1], wanted.shape[1]
    centre, scale = points.mean(axis=0), float(points.std()) or 1.0
    layers = [
        rng.normal(size=(dim, HIDDEN)) * np.sqrt(2 / dim),
        np.zeros(HIDDEN),
        rng.normal(size=(HIDDEN, parts)) * np.sqrt(1 / HIDDEN),
        np.zeros(parts),
    ]
    x = (points - centre) / scale
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for low in range(0, len(x), 256):
            rows = order[low : low + 256]
            hidden = np.maximum(x[rows] @ layers[0] + layers[1], 0)
            out = hidden @ layers[2] + layers[3]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            error = (out / out.sum(axis=1, keepdims=True) - wanted[rows]) / len(rows)
            back = (error @ layers[2].T) * (hidden > 0)
            grads = [x[rows].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            step += 1
            for k, grad in enumerate(grads):
                grad = grad + 1e-5 * layers[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                rate = 0.003 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                layers[k] = layers[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    return Router(centre, scale, layers, 1)


def fit_router(points: np.ndarray, parts: int, recall: float = RECALL, seed: int = SEED) -> Router:
    """Partition the neighbour graph of a sample, train on most of it, choose the probes on the rest."""
    dim = points.shape[1] if points.ndim == 2 else 0
    held = min(HELD_OUT, len(points) // 5)
    parts = min(parts, max(1, (len(points) - held) // (2 * NEIGHBOURS)))
    if parts < 2:
        layers = [np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)]
        return Router(np.zeros(dim), 1.0, layers, 1)
    tests, train = points[:held], points[held:]
    graph = nearest(train, train, NEIGHBOURS + 1)
    part = balanced_partition(train, graph, parts, seed)
    wanted = np.zeros((len(train), parts))
    np.add.at(wanted, (np.repeat(np.arange(len(train)), graph.shape[1]), part[graph].ravel()), 1.0 / graph.shape[1])
    router = train_router(train, wanted, seed)
    indexed = router.ranked(train, 1)[:, 0]
    truth = indexed[nearest(tests, train, NEIGHBOURS)]
    order = router.ranked(tests, parts)
    place = np.argsort(order, axis=1)
    needed = np.take_along_axis(place, truth, axis=1).ravel()
    found = np.bincount(needed, minlength=parts).cumsum() / len(needed)
    router.probes = int(np.searchsorted(found, recall)) + 1
    return router


def _routed(vectors: DataFrame, router, n: int) -> DataFrame:
    """``(vec_id, vector, part)``, a row for each of the n most probable partitions."""

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                parts = router.value.ranked(stack(frame["vector"]), n)
                yield frame.loc[frame.index.repeat(parts.shape[1])].assign(part=parts.ravel())

    return vectors.mapInPandas(route, "vec_id long, vector binary, part long")


def _rank_block(k: int):
    def rank(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        if not len(queries) or not len(block):
            return empty
        ids, points = block["vec_id"].to_numpy(), stack(block["vector"])
        norms = (points**2).sum(axis=1)
        out = []
        for low in range(0, len(queries), 128):
            some = queries.iloc[low : low + 128]
            own, wanted = some["vec_id"].to_numpy(), stack(some["vector"])
            size = (wanted**2).sum(axis=1)[:, None]
            far = size + norms - 2 * wanted @ points.T
            far[own[:, None] == ids[None, :]] = np.inf
            least = min(k, far.shape[1]) - 1
            # Rounding of the quick distance must not lose a candidate.
            bound = np.partition(far, least, axis=1)[:, [least]] + 1e-9 * (size + norms.max())
            q, c = np.nonzero((far <= bound) & np.isfinite(far))
            score = np.sqrt(((wanted[q] - points[c]) ** 2).sum(axis=1))
            order = np.lexsort((ids[c], score, q))
            q, c, score = q[order], c[order], score[order]
            starts = np.searchsorted(q, np.arange(len(some)))
            best = np.arange(len(q)) - starts[q] < k
            out.append(pd.DataFrame({"query_id": own[q[best]], "vec_id": ids[c[best]], "score": score[best]}))
        return pd.concat(out)

    return rank


def nearest_neighbours(table: DataFrame, is_query, k: int = 10, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found for every row that ``is_query`` selects,
    a condition on ``vec_id``; score is the Euclidean distance."""
    spark = table.sparkSession
    valid = stage(valid_vectors(table).where("vec_id is not null").distinct(), "vectors")
    fields = "query_id long, rank int, vec_id long, score double"
    dims = valid.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], fields)
    vectors = valid.where(F.col("dim") == dims["dim"]).select("vec_id", "vector")
    sample = stack(vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id", "vector").limit(SAMPLE).toPandas()["vector"])
    parts = min(MAX_PARTITIONS, -(-dims["count"] // PER_PARTITION))
    router = fit_router(sample, parts, recall, seed)
    sent = spark.sparkContext.broadcast(router)

    indexed = stage(_routed(vectors, sent, 1), "indexed")
    queries = stage(_routed(vectors.where(is_query), sent, router.probes), "queries")
    # One row per partition, at most ``MAX_PARTITIONS``.
    blocks = indexed.groupBy("part").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("long").alias("blocks"))
    turns = queries.groupBy("part").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("long").alias("turns"))
    cells = F.broadcast(blocks.join(turns, "part"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    points = indexed.join(cells, "part").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    points = points.withColumn("turn", upto("turns")).select("part", "block", "turn", "vec_id", "vector")
    asked = queries.join(cells, "part").withColumn("turn", F.pmod(F.xxhash64("vec_id"), F.col("turns")))
    asked = asked.withColumn("block", upto("blocks")).select("part", "block", "turn", "vec_id", "vector")
    keys = ["part", "block", "turn"]
    found = asked.groupBy(*keys).cogroup(points.groupBy(*keys))
    found = found.applyInPandas(_rank_block(k), "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

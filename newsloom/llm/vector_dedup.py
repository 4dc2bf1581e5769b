"""Near-duplicate vectors by sorted projection passes.

Each pass gives a vector a code: the concatenated signs of random projections. All vectors of a pass are
ordered by their codes, and each is compared with the next ``WINDOW`` vectors in that order. Pairs with
a cosine of ``LEAST`` or more are links; links of all passes are united into components. Equal vectors
are one class and are compared once.

Where many vectors lie close without linking they share leading signs and fill each other's windows, so
runs of equal leading signs are compared whole as well, all pairs of a run, tile by tile, in every pass. How
many signs make a run follows from the table: as many as make the comparisons fewest, ``FEWEST_BITS`` at
least. With these and ``PASSES`` passes a link of exactly ``LEAST`` is missed with a chance of 3 in a million. Each link shares the leading signs of a pass with a chance that depends on its
cosine only, not on the other vectors; there are as many passes as find a link of exactly ``LEAST`` with
a chance of ``RECALL``. Dense runs cost the square of their size, and nothing is left out of them.

A window finds a large group as a chain of links, not as all its pairs. The links of a vector are
therefore counted within its component afterwards: components are cut into tiles and pairs of tiles are
compared whole, which counts links without listing them and needs no group in one task.

Vectors that are null, empty, all zero or hold null or non-finite components link with nothing, as do
vectors of different lengths with each other. Repeated rows are separate vectors that link. A row
without id takes part and is never kept; a component without any id is null. Cosines are computed in
double precision on vectors scaled by their largest component, so that lengths neither over- nor underflow;
whatever decides a link, a product too near to the bound is computed again for the pair alone. Other
columns are not read and may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.staging import stage
from newsloom.llm.graph import connected_components
from newsloom.llm.vectors import cosine, is_valid, stack, to_bytes, unit_rows

LEAST = 0.95
PASSES = 12
BITS = 64
WINDOW = 32
CHUNK = 2048
TILE = 256
# The least chance that some pass puts the two vectors of a link into one run.
RECALL = 0.99
MOST_BITS = 24
# A further pass costs as much for each vector as so many comparisons.
PASS_COST = 2048
RUN_TILE = 512
# Runs share so many signs at least, also in small tables; what products of unit vectors may be off by.
FEWEST_BITS = 4
ROUNDING = 1e-9
SEED = 1


def _codes(classes: DataFrame, passes: int, seed: int) -> DataFrame:
    """``(turn, code, key, vector)``: each class once per pass."""

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)[::-1]
        for frame in frames:
            for dim, rows in frame.groupby("dim"):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).normal(size=(dim, passes * BITS))
                signs = (unit_rows(rows["vector"]) @ planes[dim] > 0).reshape(len(rows), passes, BITS)
                codes = (signs * weights).sum(axis=2, dtype=np.uint64) ^ np.uint64(1 << 63)
                for turn in range(passes):
                    yield rows.assign(turn=turn, code=codes[:, turn].view(np.int64))[
                        ["turn", "dim", "code", "key", "copies", "vector"]
                    ]

    return classes.mapInPandas(project, "turn int, dim int, code long, key string, copies long, vector binary")


def _ranked(coded: DataFrame) -> DataFrame:
    """Add ``rank``, the place in the order of passes and codes, without a task that sees all rows."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            places = pa.array(np.arange(place, place + n))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, task)), places], names=[*batch.schema.names, "task", "place"]
            )
            place += n

    spark = coded.sparkSession
    order = ["turn", "dim", "code", "key"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = coded.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    fields = "turn int, dim int, code long, key string, copies long, vector binary, task long, place long"
    placed = stage(placed.mapInArrow(number, fields), "ordered")
    # One row per task.
    counts = placed.groupBy("task").count().toPandas().sort_values("task")
    starts = counts["count"].cumsum() - counts["count"]
    rows = list(zip(counts["task"].tolist(), starts.tolist(), strict=True))
    offsets = spark.createDataFrame(rows, "task long, start long")
    return placed.join(F.broadcast(offsets), "task").withColumn("rank", F.col("start") + F.col("place"))


def _window_links(ranked: DataFrame, least: float, window: int) -> DataFrame:
    """Links found by comparing each vector with the next ones, as few as keep what they connect."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", ignore_index=True)
        found: list[tuple[str, str]] = []
        keys = rows["key"].to_numpy()
        root = list(range(len(rows)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for _, part in rows.groupby(["turn", "dim"]):
            matrix = unit_rows(part["vector"])
            at = part.index.to_numpy()
            for low in range(0, len(part), 256):
                near = matrix[low : low + 256] @ matrix[low : low + 256 + window].T
                i, j = np.nonzero(near >= least - ROUNDING)
                for a, b in zip(i[(j > i) & (j - i <= window)] + low, j[(j > i) & (j - i <= window)] + low, strict=True):
                    if top(at[a]) != top(at[b]) and cosine(part["vector"].iloc[a], part["vector"].iloc[b]) >= least:
                        root[top(at[a])] = top(at[b])
                        found.append((keys[at[a]], keys[at[b]]))
        return pd.DataFrame(found, columns=["a", "b"])

    chunk = F.expr(f"rank div {CHUNK}")
    # The first rows of a chunk also end the chunk before it.
    chunks = F.when((F.col("rank") % CHUNK < window) & (chunk > 0), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    dealt = ranked.select(F.explode(chunks).alias("chunk"), "rank", "turn", "dim", "key", "vector")
    return dealt.groupBy("chunk").applyInPandas(compare, "a string, b string")


def passes_needed(bits: int, least: float) -> int:
    """Passes in which a link of cosine ``least`` shares the first ``bits`` signs once, with a chance of ``RECALL``."""
    shared = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** bits
    return 1 if shared >= RECALL else math.ceil(math.log(1 - RECALL) / math.log1p(-shared))


def _run_bits(classes: DataFrame, least: float, passes: int, seed: int) -> int:
    """How many leading signs make a run, so that all passes together cost least on this table."""
    coded = _codes(classes, 1, seed)
    head = F.shiftrightunsigned("code", BITS - MOST_BITS).alias("head")
    heads = coded.groupBy("dim", head).agg(F.count("*").alias("n"))
    bits = F.explode(F.sequence(F.lit(FEWEST_BITS), F.lit(MOST_BITS))).alias("bits")
    runs = heads.select("dim", "head", "n", bits).groupBy("bits", "dim", F.expr(f"shiftrightunsigned(head, {MOST_BITS} - bits)"))
    # One row per number of bits.
    pairs = runs.agg(F.sum("n").alias("n")).groupBy("bits").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 2).alias("pairs"))
    costs = {r["bits"]: max(passes, passes_needed(r["bits"], least)) * (r["pairs"] / 2 + PASS_COST * r["n"]) for r in pairs.collect()}
    return min(sorted(costs), key=costs.get, default=FEWEST_BITS)


def _run_links(ranked: DataFrame, least: float, bits: int) -> DataFrame:
    """Links found by comparing all vectors of a run, as few as keep what they connect."""
    run = F.shiftrightunsigned("code", BITS - bits)
    rows = ranked.select("turn", "dim", run.alias("run"), "key", "vector")
    names = ["turn", "dim", "run"]
    sizes = rows.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / F.lit(RUN_TILE)).cast("long")
    tiled = rows.join(sizes, names).withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    dealt = tiled.withColumn("other", other).select(
        *names, F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "key", "vector"
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows["key"].to_numpy()
        i, j = np.nonzero(np.triu(_linked(unit_rows(rows["vector"]), rows["vector"].to_numpy(), least), 1))
        first = _first_linked(i, j, len(rows))
        linked = np.flatnonzero(first != np.arange(len(rows)))
        return pd.DataFrame({"a": keys[linked], "b": keys[first[linked]]})

    return dealt.groupBy(*names, "low", "high").applyInPandas(compare, "a string, b string")


def _first_linked(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows the first that it is connected with over the pairs ``(i, j)``."""
    first = np.arange(n)
    while True:
        lower = first.copy()
        np.minimum.at(lower, i, first[j])
        np.minimum.at(lower, j, first[i])
        lower = lower[lower]
        if (lower == first).all():
            return first
        first = lower


def _linked(matrix: np.ndarray, vectors: np.ndarray, least: float) -> np.ndarray:
    """Which rows of unit vectors link; products too near to the bound to tell are computed singly."""
    product = matrix @ matrix.T
    near = product >= least
    for i, j in zip(*np.nonzero(np.triu(np.abs(product - least) < ROUNDING, 1)), strict=True):
        near[i, j] = near[j, i] = cosine(vectors[i], vectors[j]) >= least
    np.fill_diagonal(near, False)
    return near


def _count_links(members: DataFrame, least: float) -> DataFrame:
    """``(key, linked)``: how many other rows each class links to, ``members`` being
    ``(component, key, copies, vector)``."""
    tiles = F.ceil(F.col("n") / F.lit(TILE)).cast("long")
    sized = members.join(members.groupBy("component").agg(F.count("*").alias("n")), "component")
    tile = F.pmod(F.xxhash64("key"), F.col("tiles"))
    tiled = sized.withColumn("tiles", tiles).withColumn("tile", tile)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    dealt = tiled.withColumn("other", other).select(
        "component", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "key", "copies", "vector"
    )

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        near = _linked(unit_rows(rows["vector"]), rows["vector"].to_numpy(), least)
        if rows["low"].iloc[0] != rows["high"].iloc[0]:
            tile = rows["tile"].to_numpy()
            near &= tile[:, None] != tile[None, :]
        return pd.DataFrame({"key": rows["key"], "linked": near @ rows["copies"].to_numpy()})

    counted = dealt.groupBy("component", "low", "high").applyInPandas(count, "key string, linked long")
    return counted.groupBy("key").agg(F.sum("linked").alias("linked"))


def near_duplicates(
    table: DataFrame, least: float = LEAST, passes: int = PASSES, window: int = WINDOW, seed: int = SEED
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``table(vec_id, embedding)``.

    ``passes`` is the least number of passes; there are more if runs need them."""
    vector = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v"))
    valid = rows.where(is_valid(F.col("v"))).select("vec_id", to_bytes("v").alias("vector"), F.size("v").alias("dim"))
    keyed = stage(valid.withColumn("key", F.md5("vector")), "vectors")
    classes = keyed.groupBy("key", "dim", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = stage(classes, "classes")
    vectors = classes.select("key", "dim", "copies", "vector")
    bits = _run_bits(vectors, least, passes, seed)
    ranked = _ranked(_codes(vectors, max(passes, passes_needed(bits, least)), seed))
    links = stage(_window_links(ranked, least, window).unionByName(_run_links(ranked, least, bits)), "links")
    components = connected_components(links).withColumnRenamed("node", "key")
    members = stage(classes.join(components, "key"), "members")
    linked = _count_links(members.select("component", "key", "copies", "vector"), least)
    ids = members.groupBy("component").agg(F.min("least").alias("component_id"))
    found = (
        classes.select("key", "copies", "least")
        .join(members.select("key", "component"), "key", "left")
        .join(ids, "component", "left")
        .join(linked, "key", "left")
        .select(
            "key",
            (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )
    same = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    linked_rows = keyed.select("vec_id", "key").join(found, "key")
    others = rows.where(~is_valid(F.col("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (
        linked_rows.select("vec_id", "n_links", "component_id")
        .unionByName(others)
        .select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", same.alias("kept"))
    )

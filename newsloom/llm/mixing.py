"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Token capacity flows
from the patterns to the quotas of the sources: the first use of a token is cheap, each repetition costs
more, and a document is used at most ``MAX_COPIES`` times. The flow has one row per pattern and source,
so it is solved where the job starts; the number of patterns is checked against ``max_patterns``. Where every
document has one source, more sources than that have an exact way: their flow is known and is computed in
DataFrames, with the same rows. The flow of a pattern is then spread over its documents: whole rounds over all of them, and for the rest the
documents that come first in the order of a seeded hash. One document per pattern may be taken in part,
so that the flow is met exactly.

Sizes are words. Null texts have size 0 and nothing is taken from them. A null source is a source, last
in the order. Documents without any source take no part. Repeated rows are separate documents; rows
equal in id, size and pattern have a defined order among equals. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions.staging import stage
from newsloom.llm.text import free_names

MAX_COPIES = 3
# What a token costs when used for the first, second and third time.
COPY_COSTS = (1, 2, 4)
MAX_PATTERNS = 10_000
BUCKET_BITS = 12
SEED = 1
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column | str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def cyclic_weights(sources: Sequence[str | None], weights: Sequence[float] = (1, 2, 3)) -> dict[str | None, float]:
    """Weights in turn, sources ordered by code point and null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: weights[i % len(weights)] for i, s in enumerate(ordered)}


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], total: float) -> dict[str | None, float]:
    """Share ``total`` by weight; a target stops at ``MAX_COPIES`` times its size, the excess is shared
    again among the others until none is above."""
    out: dict[str | None, float] = {}
    free = dict(weights)
    left = float(total)
    while free:
        unit = left / sum(free.values())
        full = [s for s, w in free.items() if w * unit > MAX_COPIES * sizes[s]]
        if not full:
            return out | {s: w * unit for s, w in free.items()}
        for s in full:
            out[s] = float(MAX_COPIES * sizes[s])
            left -= out[s]
            del free[s]
    return out


@dataclass
class FlowNetwork:
    """Min-cost flow by cheapest augmenting paths with node potentials; costs are not negative."""

    edges: list[list[int]] = field(default_factory=list)  # to, capacity left, cost
    leaving: dict[int, list[int]] = field(default_factory=dict)

    def add(self, start: int, end: int, capacity: int, cost: int) -> int:
        for a, b, room, price in ((start, end, capacity, cost), (end, start, 0, -cost)):
            self.leaving.setdefault(a, []).append(len(self.edges))
            self.leaving.setdefault(b, [])
            self.edges.append([b, room, price])
        return len(self.edges) - 2

    def flow(self, edge: int) -> int:
        return self.edges[edge + 1][1]

    def solve(self, start: int, end: int) -> None:
        height = dict.fromkeys(self.leaving, 0)
        while True:
            cost, came = {start: 0}, {}
            heap, done = [(0, start)], set()
            while heap:
                so_far, node = heapq.heappop(heap)
                if node in done:
                    continue
                done.add(node)
                for e in self.leaving.get(node, ()):
                    to, room, price = self.edges[e]
                    reach = so_far + price + height[node] - height[to]
                    if room > 0 and to not in done and reach < cost.get(to, reach + 1):
                        cost[to], came[to] = reach, e
                        heapq.heappush(heap, (reach, to))
            if end not in done:
                return
            for node in height:
                height[node] += min(cost.get(node, cost[end]), cost[end])
            path, node = [], end
            while node != start:
                path.append(came[node])
                node = self.edges[came[node] ^ 1][0]
            amount = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= amount
                self.edges[e ^ 1][1] += amount


def route(capacities: dict[str, int], members: dict[str, Sequence[str | None]], quotas: dict[str | None, int]) -> dict[tuple[str, str | None], int]:
    """Tokens each source takes from each pattern, as many as fit, with the fewest repetitions."""
    net, start, end = FlowNetwork(), 0, 1
    of_source = {s: 2 + i for i, s in enumerate(quotas)}
    of_pattern = {p: 2 + len(quotas) + i for i, p in enumerate(capacities)}
    arcs = {}
    for p, size in capacities.items():
        for cost in COPY_COSTS[:MAX_COPIES]:
            net.add(start, of_pattern[p], size, cost)
        for s in members[p]:
            arcs[p, s] = net.add(of_pattern[p], of_source[s], MAX_COPIES * size, 0)
    for s, quota in quotas.items():
        net.add(of_source[s], end, quota, 0)
    if capacities and quotas:
        net.solve(start, end)
    return {key: net.flow(edge) for key, edge in arcs.items()}


@dataclass
class Mix:
    """``documents``: ``(doc_id, pattern, size, taken)``. ``sources``: size and target of each source.
    ``flows``: tokens by pattern and source."""

    documents: DataFrame
    sources: dict[str | None, tuple[int, float]]
    flows: dict[tuple[str, str | None], int]


def mix(
    docs: DataFrame,
    members: Column,
    weights: dict[str | None, float] | None = None,
    seed: int = SEED,
    max_patterns: int = MAX_PATTERNS,
) -> Mix:
    """Choose what to take from each document of ``docs``; ``members`` is the array of its sources."""
    spark = docs.sparkSession
    pattern = F.to_json(F.array_sort(F.array_distinct(members)))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        pattern.alias("pattern"),
        word_count("text").alias("size"),
        F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)).alias("place"),
    ).where("pattern is not null and pattern <> '[]'")
    sized = stage(sized, "sizes")
    found = sized.groupBy("pattern").agg(F.sum("size").alias("size")).limit(max_patterns + 1)
    found = found.withColumn("members", F.from_json("pattern", "array<string>")).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} patterns of sources; raise max_patterns or merge sources")
    capacities = {r["pattern"]: r["size"] for r in sorted(found, key=lambda r: r["pattern"])}
    in_pattern = {r["pattern"]: list(r["members"]) for r in found}
    sizes: dict[str | None, int] = {}
    for p, size in capacities.items():
        for s in in_pattern[p]:
            sizes[s] = sizes.get(s, 0) + size
    wanted = targets(sizes, weights or cyclic_weights(list(sizes)), sum(capacities.values()))
    flows = route(capacities, in_pattern, {s: round(t) for s, t in wanted.items()})
    rows = []
    for p, size in capacities.items():
        amount = sum(flows[p, s] for s in in_pattern[p])
        rounds = min(MAX_COPIES, amount // size) if size else 0
        rows.append((p, rounds, amount - rounds * size))
    plan = F.broadcast(spark.createDataFrame(rows, "pattern string, rounds long, rest long"))
    taken = _spread(sized, plan)
    return Mix(taken, {s: (sizes[s], wanted[s]) for s in sizes}, flows)


def _spread(sized: DataFrame, plan: DataFrame, few: bool = True) -> DataFrame:
    """Take whole rounds of a pattern and its rest from the documents that come first by ``place``.

    Sizes are summed by the leading bits of the place; only the documents in the one bucket of a pattern
    where its rest ends are put in order.
    """
    bucket = F.shiftrightunsigned("place", 64 - BUCKET_BITS)
    placed = sized.withColumn("bucket", bucket)
    upto = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        placed.groupBy("pattern", "bucket")
        .agg(F.sum("size").alias("words"))
        .withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    )
    cuts = (
        buckets.join(plan, "pattern")
        .where("before <= rest and rest < before + words")
        .groupBy("pattern")
        .agg(F.min("bucket").alias("cut"), F.min(F.struct("bucket", "before"))["before"].alias("before"))
    )
    planned = plan.join(cuts, "pattern", "left")
    # Of patterns that are too many to send, a hot one is split by adaptive execution.
    planned = placed.join(planned.hint("broadcast") if few else stage(planned, "plan"), "pattern")
    inside = F.col("bucket") == F.col("cut")
    order = Window.partitionBy("pattern").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = planned.where(inside).withColumn("sum", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    extra = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("sum")))
    others = planned.where(~F.coalesce(inside, F.lit(False)))
    more = F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(0)
    columns = ["doc_id", "pattern", "size"]
    base = F.col("rounds") * F.col("size")
    return at_cut.select(*columns, (base + extra).alias("taken")).unionByName(
        others.select(*columns, (base + more).alias("taken"))
    )


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``number``, the place in an order from 0, without a task that sees all rows."""
    within = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = stage(within.withColumn("task", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1)), "numbered")
    # One row per task.
    counts = placed.groupBy("task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("task", before.alias("start")))
    return placed.join(starts, "task").withColumn("number", F.col("start") + F.col("at")).drop("task", "at", "start")


def _filled(sources: DataFrame, total: int) -> float:
    """The unit at which ``weight * unit``, but ``MAX_COPIES`` times the size at most, adds up to ``total``.

    A source is full below the unit that its size stands for. Each step gives what full sources leave over
    to the others, which raises the unit, until no further source is full.
    """
    room = MAX_COPIES * F.col("size")
    unit = -1.0
    while True:
        full = F.col("weight") * F.lit(unit) > room
        taken, free = sources.agg(F.coalesce(F.sum(F.when(full, room)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        raised = (total - taken) / free if free else unit
        if not free or raised <= unit:
            return unit
        unit = raised


def mix_of_single_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """What ``mix`` gives where every document has one source, for any number of sources.

    A pattern is a source then, and the flow is known: each source takes its target, rounded, or all that its
    documents can give. Returns ``(doc_id, pattern, size, taken)`` and ``(pattern, source_size, target)``.
    """
    source = F.col("source").cast("string")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.to_json(F.array(source)).alias("pattern"),
        source.alias("source"),
        word_count("text").alias("size"),
        F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)).alias("place"),
    )
    sized = stage(sized, "sizes")
    sources = sized.groupBy("pattern", "source").agg(F.sum("size").alias("size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    numbered = _numbered(sources, [F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8")])
    weighed = stage(numbered.withColumn("weight", F.get(cycle, (F.col("number") % len(weights)).cast("int"))), "weighed")
    total = weighed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    room = MAX_COPIES * F.col("size")
    target = F.least(F.col("weight") * F.lit(_filled(weighed, total)), room.cast("double"))
    aimed = stage(weighed.select("pattern", F.col("size").alias("source_size"), target.alias("target")), "targets")
    amount = F.least(F.bround("target").cast("long"), MAX_COPIES * F.col("source_size"))
    size = F.col("source_size")
    rounds = F.when(size > 0, F.least(F.lit(MAX_COPIES), F.expr("amount div source_size"))).otherwise(F.lit(0))
    plan = aimed.withColumn("amount", amount).withColumn("rounds", rounds.cast("long"))
    plan = plan.select("pattern", "rounds", (F.col("amount") - F.col("rounds") * size).alias("rest"))
    return _spread(sized.drop("source"), plan, few=False), aimed


def _mixed(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents and the sources of a mix: by the flow, or beyond what it is solved for by its known answer."""
    source = F.col("source").cast("string")
    if docs.select(source.alias("source")).distinct().limit(MAX_PATTERNS + 1).count() > MAX_PATTERNS:
        return mix_of_single_sources(docs, seed=seed)
    chosen = mix(docs, F.array(source), seed=seed)
    return chosen.documents, F.broadcast(_source_table(docs, chosen))


def mix_by_source(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for documents that have one source each."""
    documents, sources = _mixed(docs, seed)
    return documents.join(sources, "pattern").select("doc_id", "size", "source_size", "target", "taken")


def _source_table(docs: DataFrame, chosen: Mix) -> DataFrame:
    """One row per source, as many as patterns at most."""
    rows = [(s, *values) for s, values in chosen.sources.items()]
    table = docs.sparkSession.createDataFrame(rows, "source string, source_size long, target double")
    return table.select(F.to_json(F.array("source")).alias("pattern"), "source_size", "target")


def apply_mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents of the mix with their columns, a row per copy. A document taken in part counts as
    the nearest number of copies; documents without words stay out.

    Rows that share an id share their copies; if ids repeat, the copies of the id are its mean.
    """
    own_id, copies, copy = free_names(docs.columns, "_id", "_copies", "_copy")
    chosen, _ = _mixed(docs, seed)
    number = (
        chosen.where("taken > 0")
        .groupBy("doc_id")
        .agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias(copies))
        .where(F.col(copies) > 0)
        .select(F.col("doc_id").alias(own_id), copies)
    )
    kept = docs.join(number, F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)))
    return kept.withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).drop(own_id, copies, copy)

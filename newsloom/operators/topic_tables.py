"""Topic models kept as tables, for vocabularies of any size.

Nothing that grows with the vocabulary or the collection passes through the driver. Documents are dealt into
parts of one to four million tokens by a hash of their id and tokens, and words into buckets by their hash, where
they have numbers. Each step picks the weights of a part's words from the buckets, brings them and the documents
together in one task (a cogroup), and writes the new state of the part to the shared folder: its documents, what
its tokens add to the weights of its words, a block of numbers per bucket, and sums of one number per topic, which
are all that the driver reads. Then the blocks of a bucket are added up. What a step has shuffled is deleted when
it is done.

Two trainers share this:

- ``gibbs``: collapsed Gibbs sampling. Each part draws new topics with the merged counts of the step before
  and its own newest ones; counts are merged after every ``sweeps_per_merge`` sweeps, and the topics' priors
  are estimated anew (Minka's fixed point).
- ``variational``: variational Bayes over all documents in each step. Its result does not depend on how
  documents are dealt, but for the order of sums.

The first topics are drawn from the seed and the part, so that equal seeds give equal models for the same
rows, in any order. Rows that are equal in id and tokens stand in one part.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.staging import drop_path, drop_stage, free_shuffles, scratch_path, stage
from newsloom.operators import topic_sampling as S
from newsloom.operators.lemma_rules import prepare_tokens

# Tokens of a part: the more of them, the fewer words stand in several parts; few parts would leave cores idle.
TOKENS_PER_PART, MOST_TOKENS_PER_PART, ENOUGH_PARTS = 1 << 20, 1 << 22, 16
# Topics up to which a part may have the most tokens.
FEW_TOPICS = 64
# Bytes of the blocks of a bucket.
BUCKET_BYTES = 64 << 20
GIBBS, VARIATIONAL = "gibbs", "variational"
DOCUMENT, TERM, TOTALS = 0, 1, 2
# What a part is made of: documents (codes of terms, by place among the part's sorted terms, and a topic or
# a count for each), terms (their places, topics and values; later a row per bucket: the terms' numbers in it,
# their places and values by term and topic) and totals (values).
STATE = "part int, place long, term string, codes array<int>, topics array<int>, values array<double>, kind int"
STATE_FIELDS = [
    ("part", pa.int32()), ("place", pa.int64()), ("term", pa.string()), ("codes", pa.list_(pa.int32())),
    ("topics", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("kind", pa.int32()),
]


# --- documents in parts ---


def _flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column and the offsets of its rows in them."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), np.concatenate(([0], np.cumsum(sizes)))


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    values, bounds = _flat(column)
    return values.to_numpy(zero_copy_only=False), bounds


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def _sorted_terms(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table["term"]))


def _parts(total: int, tokens_per_part: int | None, num_topics: int) -> int:
    if tokens_per_part is not None:
        return max(1, math.ceil(total / tokens_per_part))
    most = max(TOKENS_PER_PART, MOST_TOKENS_PER_PART * FEW_TOPICS // max(num_topics, FEW_TOPICS))
    return max(1, math.ceil(total / most), min(math.ceil(total / TOKENS_PER_PART), ENOUGH_PARTS))


def _deal(tokens: DataFrame, tokens_per_part: int | None, num_topics: int = 1, path: str | None = None) -> DataFrame:
    """``(part, key, tokens, row)``, stored; ``row`` holds all other columns."""
    kept = [F.col(name) for name in tokens.columns if name != "tokens"]
    path = path or scratch_path(tokens.sparkSession, "dealt")
    rows = tokens.select(F.xxhash64("id", "tokens").alias("key"), "tokens", F.struct(*kept).alias("row"))
    rows.write.parquet(path)
    dealt = tokens.sparkSession.read.schema(rows.schema).parquet(path)
    parts = _parts(dealt.agg(F.sum(F.size("tokens"))).first()[0] or 0, tokens_per_part, num_topics)
    return dealt.select(F.pmod("key", F.lit(parts)).cast("int").alias("part"), "key", "tokens", "row")


def _terms_of(dealt: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` rows (by ``term``) for each part (``of``) that needs them."""
    pairs = dealt.select(F.col("part").alias("of"), F.explode(F.array_distinct("tokens")).alias("term")).distinct()
    return pairs.join(known, "term")


def _coded(documents: pa.Table, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places of all known tokens among ``terms``, and the offsets of the documents in them."""
    flat, bounds = _flat(documents["tokens"])
    places = pc.index_in(flat, value_set=terms)
    known = places.is_valid().to_numpy(zero_copy_only=False)
    passed = np.concatenate(([0], np.cumsum(known)))
    return places.drop_null().to_numpy().astype(np.int64), passed[bounds]


def _counted(codes: np.ndarray, bounds: np.ndarray, num_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes of each document, their counts, and the offsets of the documents in them."""
    owners = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    keys, n = np.unique(owners * max(num_terms, 1) + codes, return_counts=True)
    found = np.searchsorted(keys, np.arange(len(bounds)) * max(num_terms, 1))
    return keys % max(num_terms, 1), n, found


def _rows(part: int, kind: int, size: int, **columns: pa.Array) -> pa.Table:
    columns |= {"part": pa.array(np.full(size, part, dtype=np.int32)), "kind": pa.array(np.full(size, kind, dtype=np.int32))}
    return pa.table([columns.get(name, pa.nulls(size, form)) for name, form in STATE_FIELDS], schema=pa.schema(STATE_FIELDS))


def _term_rows(part: int, terms: pa.Array, matrix: np.ndarray) -> pa.Table:
    rows, cols = np.nonzero(matrix)
    bounds = np.searchsorted(rows, np.arange(len(matrix) + 1))
    return _rows(part, TERM, len(terms), place=pa.array(np.arange(len(terms))), term=terms, topics=_lists(cols, bounds, pa.int32()), values=_lists(matrix[rows, cols], bounds, pa.float64()))


def _blocks(parts: np.ndarray, bucket: np.ndarray, codes: np.ndarray, places: np.ndarray, matrix: np.ndarray) -> pa.Table:
    """What parts add to terms, which stand by part and bucket: a row for each part and bucket."""
    starts = np.flatnonzero((np.diff(parts, prepend=-1) != 0) | (np.diff(bucket, prepend=-1) != 0))
    bounds, num_topics = np.append(starts, len(codes)), matrix.shape[1]
    rows = _rows(
        0, TERM, len(starts), place=pa.array(bucket[starts].astype(np.int64)), codes=_lists(codes, bounds, pa.int32()),
        topics=_lists(places, bounds, pa.int32()), values=_lists(matrix.astype(np.float64).ravel(), bounds * num_topics, pa.float64()),
    )
    return rows.set_column(0, "part", pa.array(parts[starts].astype(np.int32)))


@dataclass
class Needed:
    """The terms of a part by bucket, their numbers there and their places among the part's terms."""

    buckets: np.ndarray
    codes: np.ndarray
    places: np.ndarray

    @classmethod
    def read(cls, rows: pa.Table, num_topics: int) -> tuple[Needed, np.ndarray]:
        """The terms, and their weights by place and topic."""
        rows = rows.take(pc.sort_indices(rows["place"]))
        codes, bounds = _numbers(rows["codes"])
        buckets = np.repeat(rows["place"].to_numpy().astype(np.int64), np.diff(bounds))
        found = cls(buckets, codes, _numbers(rows["places"])[0])
        weights = np.empty((len(codes), num_topics))
        weights[found.places] = _numbers(rows["weights"])[0].reshape(-1, num_topics)
        return found, weights

    def blocks(self, part: int, added: np.ndarray) -> pa.Table:
        return _blocks(np.full(len(self.codes), part), self.buckets, self.codes, self.places, added[self.places])


def _total_row(part: int, values: np.ndarray) -> pa.Table:
    return _rows(part, TOTALS, 1, values=_lists(values, np.array([0, len(values)]), pa.float64()))


def _matrix(table: pa.Table, num_topics: int) -> np.ndarray:
    """Weights by term and topic from ``(topics, values)``."""
    topics, bounds = _numbers(table["topics"])
    values, _ = _numbers(table["values"])
    out = np.zeros((table.num_rows, num_topics))
    out[np.repeat(np.arange(table.num_rows), np.diff(bounds)), topics] = values
    return out


def _part_of(key: tuple) -> int:
    return key[0].as_py()


# --- training ---


def _begin(kind: str, num_topics: int, seed: int) -> Callable:
    """Code the documents of a part by its terms and give each token a random topic."""

    def begin(key: tuple, documents: pa.Table, known: pa.Table) -> pa.Table:
        part = _part_of(key)
        documents = documents.take(pc.sort_indices(documents, sort_keys=[("key", "ascending")]))
        terms = _sorted_terms(known)["term"].combine_chunks()
        codes, bounds = _coded(documents, terms)
        bounds = np.concatenate(([0], bounds[1:][np.diff(bounds) > 0]))  # without documents that have no known term
        topics = np.random.default_rng([seed, part]).integers(num_topics, size=len(codes))
        counts = S.topic_counts(codes, topics, len(terms), num_topics)
        if kind == VARIATIONAL:
            codes, values, bounds = _counted(codes, bounds, len(terms))
            columns = {"values": _lists(values, bounds, pa.float64())}
        else:
            columns = {"topics": _lists(topics, bounds, pa.int32())}
        size = len(bounds) - 1
        rows = _rows(part, DOCUMENT, size, place=pa.array(np.arange(size)), codes=_lists(codes, bounds, pa.int32()), **columns)
        return pa.concat_tables([rows, _term_rows(part, terms, counts), _total_row(part, counts.sum(axis=0))])

    return begin


def _documents_in_order(documents: pa.Table) -> pa.Table:
    return documents.take(pc.sort_indices(documents, sort_keys=[("place", "ascending")]))


def _gibbs_step(alpha: np.ndarray, beta: float, totals: np.ndarray, num_terms: int, seed: int, step: int, sweeps: int) -> Callable:
    def sample(key: tuple, documents: pa.Table, needed: pa.Table) -> pa.Table:
        part, (terms, weights) = _part_of(key), Needed.read(needed, len(alpha))
        documents = _documents_in_order(documents)
        codes, bounds = _numbers(documents["codes"])
        topics = _numbers(documents["topics"])[0].astype(np.int64)
        codes, counts, own_totals = codes.astype(np.int64), weights.astype(np.int64), totals.copy()
        random = np.random.default_rng([seed, part, step])
        for _ in range(sweeps):
            S.gibbs_sweep(codes, bounds, topics, counts, own_totals, alpha, beta, num_terms, random)
        added = S.topic_counts(codes, topics, len(weights), len(alpha))
        rows = _rows(
            part, DOCUMENT, documents.num_rows, place=documents["place"].combine_chunks(),
            codes=_lists(codes, bounds, pa.int32()), topics=_lists(topics, bounds, pa.int32()),
        )
        sums = np.concatenate((added.sum(axis=0), S.alpha_statistics(bounds, topics, alpha)))
        return pa.concat_tables([rows, terms.blocks(part, added), _total_row(part, sums)])

    return sample


def _variational_step(alpha: np.ndarray) -> Callable:
    def expect(key: tuple, documents: pa.Table, needed: pa.Table) -> pa.Table:
        part, (terms, weights) = _part_of(key), Needed.read(needed, len(alpha))
        codes, bounds = _numbers(documents["codes"])
        n = _numbers(documents["values"])[0]
        added = np.zeros_like(weights)
        S.variational(codes.astype(np.int64), n, bounds, weights, alpha, added)
        return pa.concat_tables([terms.blocks(part, added), _total_row(part, added.sum(axis=0))])

    return expect


def word_weights(kind: str, matrix: np.ndarray, totals: np.ndarray, beta: float, num_terms: int) -> np.ndarray:
    """How likely each term is in each topic, up to a factor per term."""
    if kind == GIBBS:
        return (matrix + beta) / (totals + num_terms * beta)
    return np.exp(S.digamma(matrix + beta) - S.digamma(totals + num_terms * beta))


def _state(spark: SparkSession, path: str, kind: int) -> DataFrame:
    return spark.read.schema(STATE).parquet(path).where(F.col("kind") == kind)


def _numbered(known: DataFrame, buckets: int) -> DataFrame:
    """``(term, bucket, code)`` of all terms, stored."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
    code = F.row_number().over(W.partitionBy("bucket").orderBy("term")) - 1
    return stage(known.select("term", bucket).withColumn("code", code), "numbered_terms")


def _in_blocks(terms: DataFrame, numbered: DataFrame, num_topics: int) -> DataFrame:
    """Rows of terms as a row for each part and bucket, stored."""

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("part", "ascending"), ("code", "ascending")]))
        columns = [rows[name].to_numpy() for name in ("part", "bucket", "code", "place")]
        return _blocks(*columns, _matrix(rows, num_topics))

    found = terms.select("part", "place", "term", "topics", "values").join(numbered, "term")
    return stage(found.drop("term").groupBy("bucket").applyInArrow(gather, STATE), "first_blocks")


def _merged(blocks: DataFrame, num_topics: int) -> DataFrame:
    """``(place, values)``, stored: the parts' blocks of each bucket added up, by term and topic."""

    def merge(key: tuple, blocks: pa.Table) -> pa.Table:
        blocks = blocks.take(pc.sort_indices(blocks["part"]))
        codes, bounds = _numbers(blocks["codes"])
        values = _numbers(blocks["values"])[0].reshape(-1, num_topics)
        total = np.zeros((int(codes.max(initial=-1)) + 1, num_topics))
        for low, high in zip(bounds, bounds[1:], strict=False):
            total[codes[low:high]] += values[low:high]
        return pa.table({"place": pa.array([_part_of(key)], pa.int64()), "values": _lists(total.ravel(), np.array([0, total.size]), pa.float64())})

    found = blocks.select("place", "part", "codes", "values").groupBy("place").applyInArrow(merge, "place long, values array<double>")
    return stage(found, "topic_sums")


def _picked(lists: DataFrame, merged: DataFrame, num_topics: int, weigh: Callable[[np.ndarray], np.ndarray], form: str) -> DataFrame:
    """``(of, place, codes, places, weights)``: for each part what ``weigh`` makes of the sums of its terms."""

    def pick(key: tuple, lists: pa.Table, sums: pa.Table) -> pa.Table:
        weights = weigh(_numbers(sums["values"])[0].reshape(-1, num_topics))
        codes, bounds = _numbers(lists["codes"])
        values = _lists(weights[codes].ravel(), bounds * num_topics, pa.float32() if form == "float" else pa.float64())
        return pa.table({"of": lists["part"], "place": lists["place"], "codes": lists["codes"], "places": lists["places"], "weights": values})

    together = lists.groupBy("place").cogroup(merged.groupBy("place"))
    return together.applyInArrow(pick, f"of int, place long, codes array<int>, places array<int>, weights array<{form}>")


def _as_table(numbered: DataFrame, merged: DataFrame, num_topics: int) -> DataFrame:
    """``(term, topics, values)`` of all terms; topics whose value is 0 have no entry."""

    def rows(key: tuple, terms: pa.Table, sums: pa.Table) -> pa.Table:
        found = _numbers(sums["values"])[0].reshape(-1, num_topics)
        codes = terms["code"].to_numpy()
        matrix = np.zeros((len(codes), num_topics))
        matrix[codes < len(found)] = found[codes[codes < len(found)]]
        owners, topics = np.nonzero(matrix)
        bounds = np.searchsorted(owners, np.arange(len(matrix) + 1))
        values = _lists(matrix[owners, topics], bounds, pa.float64())
        return pa.table({"term": terms["term"], "topics": _lists(topics, bounds, pa.int32()), "values": values})

    together = numbered.groupBy("bucket").cogroup(merged.withColumn("bucket", F.col("place").cast("int")).groupBy("bucket"))
    return together.applyInArrow(rows, "term string, topics array<int>, values array<double>")


def _sums(spark: SparkSession, path: str, size: int) -> np.ndarray:
    """The totals of all parts added up: ``size`` numbers, a few per topic."""
    rows = _state(spark, path, TOTALS).select(F.posexplode("values").alias("pos", "value"))
    found = rows.groupBy("pos").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(size)
    out[found["pos"]] = found["value"]
    return out


def _write_state(found: DataFrame, spark: SparkSession) -> str:
    path = scratch_path(spark, "topic_state")
    found.write.partitionBy("kind").parquet(path)
    return path


def train_tables(
    tokens: DataFrame,
    vocabulary: DataFrame,
    num_topics: int,
    kind: str = GIBBS,
    iterations: int = 100,
    alpha: float | list[float] | None = None,
    beta: float | None = None,
    optimize_interval: int = 10,
    sweeps_per_merge: int = 1,
    seed: int = 1,
    tokens_per_part: int | None = None,
) -> TopicTable:
    """A model of ``(id, tokens)`` over the terms of ``vocabulary``.

    ``alpha`` is the prior of all topics or of each, by default ``50 / num_topics`` for sampling, re-estimated
    every ``optimize_interval`` merges (0: never), and ``1 / num_topics`` for variational steps; ``beta`` that
    of terms, 0.01 and ``1 / num_topics``. ``iterations`` are sweeps or steps over all documents.
    """
    if kind not in (GIBBS, VARIATIONAL):
        raise ValueError(f"unknown kind of topic model: {kind}")
    if num_topics < 1 or iterations < 0 or sweeps_per_merge < 1:
        raise ValueError("a model has one topic at least, no negative number of iterations, and merges sweeps")
    spark = tokens.sparkSession
    alpha = (50 if kind == GIBBS else 1) / num_topics if alpha is None else alpha
    alpha = np.full(num_topics, alpha, dtype=np.float64) if np.isscalar(alpha) else np.array(alpha, dtype=np.float64)
    if alpha.shape != (num_topics,):
        raise ValueError("alpha is one number, or one for each topic")
    beta = (0.01 if kind == GIBBS else 1 / num_topics) if beta is None else beta

    known = stage(vocabulary.select("term"), "known_terms")
    num_terms = known.count()
    free_shuffles(spark)
    tokens_path = scratch_path(spark, "dealt")
    dealt = _deal(tokens.select("id", "tokens"), tokens_per_part, num_topics, tokens_path)
    needed = _terms_of(dealt, known)
    begun = dealt.select("part", "key", "tokens").groupBy("part").cogroup(needed.groupBy("of")).applyInArrow(_begin(kind, num_topics, seed), STATE)
    first = path = documents = _write_state(begun, spark)
    drop_path(spark, tokens_path)
    del dealt, needed, begun
    free_shuffles(spark)
    totals = _sums(spark, path, num_topics)
    terms = _state(spark, path, TERM)
    buckets = max(1, math.ceil(8 * num_topics * max(num_terms, terms.count()) / BUCKET_BYTES))
    numbered = _numbered(known, buckets)
    blocks = _in_blocks(terms, numbered, num_topics)
    # The terms of each part stay the same.
    lists = stage(blocks.select("part", "place", "codes", F.col("topics").alias("places")), "terms_of_parts")
    merged = _merged(blocks, num_topics)
    drop_stage(blocks)
    free_shuffles(spark)

    merges = math.ceil(iterations / sweeps_per_merge) if kind == GIBBS else iterations
    for step in range(merges):
        if not totals.any():
            break
        if kind == GIBBS:
            sweeps = min(sweeps_per_merge, iterations - step * sweeps_per_merge)
            work = _gibbs_step(alpha, beta, totals, num_terms, seed, step + 1, sweeps)
            weights = _picked(lists, merged, num_topics, lambda sums: sums, "double")
            documents = path
        else:
            work = _variational_step(alpha)
            weigh = lambda sums, totals=totals: word_weights(VARIATIONAL, sums, totals, beta, num_terms)
            weights = _picked(lists, merged, num_topics, weigh, "float")
        # Blocks that are merged are not read again.
        drop_path(spark, f"{path}/kind={TERM}")
        grouped = _state(spark, documents, DOCUMENT).groupBy("part").cogroup(weights.groupBy("of"))
        before, path, old = path, _write_state(grouped.applyInArrow(work, STATE), spark), merged
        del weights, grouped
        free_shuffles(spark)
        sums = _sums(spark, path, 2 * num_topics + 1)
        if before != documents or kind == GIBBS:
            drop_path(spark, before)
        totals = sums[:num_topics]
        merged = _merged(_state(spark, path, TERM), num_topics)
        drop_stage(old)
        free_shuffles(spark)
        if kind == GIBBS and optimize_interval and (step + 1) % optimize_interval == 0:
            alpha = S.next_alpha(alpha, sums[num_topics:])
    weights = stage(_as_table(numbered, merged, num_topics), "topic_weights")
    for folder in {first, path, documents}:  # a folder that is gone already is no error
        drop_path(spark, folder)
    for table in (lists, merged, numbered):
        drop_stage(table)
    free_shuffles(spark)
    return TopicTable(kind, weights, alpha.tolist(), beta, totals.tolist(), num_terms)


# --- the model ---


ABOUT = "kind string, alpha array<double>, beta double, totals array<double>, num_terms long"


@dataclass
class TopicTable:
    """``weights`` has ``(term, topics, values)`` for every term: token counts by topic, or expected ones.

    It is used like a ``TopicModel``: ``phrases``, ``lemmas`` and ``rules`` are those its tokens were made with.
    """

    kind: str
    weights: DataFrame
    alpha: list[float]
    beta: float
    totals: list[float]
    num_terms: int
    phrases: DataFrame | None = None
    lemmas: DataFrame | None = None
    rules: DataFrame | None = None

    @property
    def num_topics(self) -> int:
        return len(self.alpha)

    def prepare(self, texts: DataFrame) -> DataFrame:
        """Tokens of ``(id, text)`` as the training texts had them, before phrases are merged."""
        return prepare_tokens(texts, self.lemmas, self.rules)

    def shares(self, tokens: DataFrame, tokens_per_part: int | None = None) -> DataFrame:
        """``(id, shares, has_terms)`` and the other columns; each document by variational steps.

        The tokens are dealt into parts and meet the weights of their terms there. On a stream use
        ``tag_in_batches``: batches are tables.
        """
        if tokens.isStreaming:
            raise ValueError("a model in tables meets streams in batches; use newsloom.streaming.tag_in_batches")
        kept = [field for field in tokens.schema.fields if field.name != "tokens"]
        alpha, totals = np.array(self.alpha), np.array(self.totals)
        kind, beta, num_terms, num_topics = self.kind, self.beta, self.num_terms, self.num_topics

        def infer(key: tuple, documents: pa.Table, needed: pa.Table) -> pa.Table:
            needed = _sorted_terms(needed)
            codes, bounds = _coded(documents, needed["term"].combine_chunks())
            codes, n, bounds = _counted(codes, bounds, needed.num_rows)
            weights = word_weights(kind, _matrix(needed, num_topics), totals, beta, num_terms)
            gamma = S.variational(codes, n, bounds, weights, alpha)
            has_terms = np.diff(bounds) > 0
            shares = np.where(has_terms[:, None], gamma / gamma.sum(axis=1, keepdims=True), 0.0)
            every = np.arange(len(shares) + 1) * num_topics
            return pa.table({"row": documents["row"], "shares": _lists(shares.ravel(), every, pa.float64()), "has_terms": pa.array(has_terms)})

        dealt = _deal(tokens, tokens_per_part, num_topics)
        row = dealt.schema["row"].dataType.simpleString()
        needed = _terms_of(dealt, self.weights)
        found = dealt.select("part", "tokens", "row").groupBy("part").cogroup(needed.groupBy("of"))
        inferred = found.applyInArrow(infer, f"row {row}, shares array<double>, has_terms boolean")
        return inferred.select(*[F.col("row").getField(field.name).alias(field.name) for field in kept], "shares", "has_terms")

    def term_weights(self) -> DataFrame:
        """``(topic_id, term_id, term, weight)`` for all topics and terms; terms have no numbers here."""
        prior = self.beta if self.kind == VARIATIONAL else 0.0
        every = F.sequence(F.lit(0), F.lit(self.num_topics - 1))
        known = F.map_from_arrays("topics", "values")
        cells = self.weights.select("term", known.alias("known"), F.explode(every).alias("topic_id"))
        weight = F.coalesce(F.try_element_at("known", F.col("topic_id")), F.lit(0.0)) + F.lit(prior)
        return cells.select("topic_id", F.lit(None).cast("int").alias("term_id"), "term", weight.alias("weight"))

    def write_parts(self, folder: str) -> None:
        self.weights.write.parquet(f"{folder}/weights")
        row = (self.kind, self.alpha, self.beta, self.totals, self.num_terms)
        self.weights.sparkSession.createDataFrame([row], ABOUT).coalesce(1).write.parquet(f"{folder}/about")

    @classmethod
    def read_parts(cls, spark: SparkSession, folder: str, **tables: DataFrame | None) -> TopicTable:
        about = spark.read.schema(ABOUT).parquet(f"{folder}/about").first()
        weights = spark.read.schema("term string, topics array<int>, values array<double>").parquet(f"{folder}/weights")
        return cls(about.kind, weights, about.alpha, about.beta, about.totals, about.num_terms, **tables)

"""LDA by steps over all documents, with a model that a task can hold.

Tasks read documents as numbers of terms and meet the model as one matrix, a row per term. Each task sends the
sum of its documents, a row per term it has, and these are added up by term; so a step moves a matrix per
task, and there are no more tasks than cores. Sums are whole numbers of ``1 / UNITS``, so that their order
does not matter and equal seeds give equal models.

- ``online``: variational Bayes on mini batches drawn with replacement (Hoffman, Blei and Bach).
- ``em``: expectation maximisation with the topics of all documents kept (Asuncion and others).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.lookup import TermIndex
from newsloom.functions.staging import drop_path, scratch_path
from newsloom.operators import topic_sampling as S

UNITS = float(1 << 24)
# Tokens whose codes are held at once.
PIECE_TOKENS = 1 << 19
GAMMA_SHAPE = 100.0
LARGEST = 1 << 62
# Terms whose numbers are worked on or sent at once.
PIECE_TERMS = 1 << 16
# Numbers that are no terms: sums per topic, and how many documents there are.
PER_TOPIC, DOCUMENTS = -1, -2


def pieces(lists: pa.ListArray, size: int = PIECE_TOKENS) -> Iterator[pa.ListArray]:
    """Stretches of rows of about ``size`` values; a longer row stands alone."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
    cuts = np.flatnonzero(np.diff(before // size)) + 1
    for low, high in zip((0, *cuts), (*cuts, len(lists)), strict=True):
        if high > low:
            yield lists.slice(low, high - low)


def coded(lists: pa.ListArray, terms: TermIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct known terms of each row by place among ``terms``, their counts, and the offsets of the rows."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    places = terms.find(lists.flatten())
    owners = np.repeat(np.arange(len(lengths)), lengths)[places >= 0]
    width = max(len(terms), 1)
    keys, n = np.unique(owners * width + places[places >= 0], return_counts=True)
    return keys % width, n.astype(np.float64), np.searchsorted(keys, np.arange(len(lengths) + 1) * width)


def code_documents(tokens: DataFrame, terms: pa.Array) -> DataFrame:
    """``(key, codes, n)`` of documents with a known term; ``key`` is a hash of id and tokens."""
    sent = tokens.sparkSession.sparkContext.broadcast(TermIndex(terms))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for lists in pieces(batch.column(1)):
                codes, n, bounds = coded(lists, sent.value)
                found = pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(lists)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(codes.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(n)),
                    ],
                    names=["key", "codes", "n"],
                )
                done += len(lists)
                yield found.filter(pa.array(np.diff(bounds) > 0))

    return tokens.select(F.xxhash64("id", "tokens").alias("key"), "tokens").mapInArrow(
        code, "key long, codes array<int>, n array<double>"
    )


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64 hashed bits of each number."""
    x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray, salt: int) -> np.ndarray:
    return ((_mixed(x, salt) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _drawn(keys: np.ndarray, rate: float, seed: int, step: int) -> np.ndarray:
    """How often each document is in the batch of a step: Poisson numbers, a function of key, seed and step."""
    u = _uniform(_mixed(keys, seed), step)
    times, chance = np.zeros(len(keys), dtype=np.int64), np.exp(-rate)
    passed, k = chance, 0
    while (u >= passed).any() and k < 100:
        times += u >= passed
        k += 1
        chance *= rate / k
        passed += chance
    return times


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column("codes")
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return batch.column("key").to_numpy(), lists.flatten().to_numpy().astype(np.int64), batch.column("n").flatten().to_numpy(), bounds


def _fixed(values: np.ndarray) -> list[pa.Array]:
    return [pa.array(column) for column in np.rint(values * UNITS).clip(-LARGEST, LARGEST).astype(np.int64).T]


def sent_sums(sums: np.ndarray, per_topic: np.ndarray, documents: int) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """Numbers of terms and the columns of a task's sums, some terms at a time."""
    for low in range(0, len(sums), PIECE_TERMS):
        piece = sums[low : low + PIECE_TERMS]
        seen = np.flatnonzero(piece.any(axis=1))
        if len(seen):
            yield seen + low, _fixed(piece[seen])
    rest = np.zeros((2, sums.shape[1]))
    rest[0], rest[1, 0] = per_topic, documents
    yield np.array([PER_TOPIC, DOCUMENTS]), _fixed(rest)


def _added(rows: DataFrame, size: int, num_topics: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums of all tasks by term, per topic, and the number of documents."""
    names = [f"v{k}" for k in range(num_topics)]
    found = rows.groupBy("code").agg(*[F.sum(name).alias(name) for name in names]).toArrow()
    out = np.zeros((size + 2, num_topics))
    for batch in found.to_batches(PIECE_TERMS):
        codes = batch.column("code").to_numpy()
        for k, name in enumerate(names):
            out[codes, k] = batch.column(name).to_numpy() / UNITS
    return out[:size], out[PER_TOPIC], out[DOCUMENTS, 0]


def _few(documents: DataFrame) -> DataFrame:
    return documents.coalesce(max(1, documents.sparkSession.sparkContext.defaultParallelism))


def _concentrations(given: float | list[float] | None, num_topics: int, default: float) -> np.ndarray:
    given = [default] if given is None else np.atleast_1d(np.array(given, dtype=np.float64))
    if len(given) not in (1, num_topics):
        raise ValueError("docConcentration is one number, or one for each topic")
    return np.broadcast_to(np.array(given, dtype=np.float64), num_topics).copy()


def _trigamma(x: np.ndarray) -> np.ndarray:
    out, x = np.zeros_like(x), x.astype(np.float64)
    for _ in range(6):
        out, x = out + np.where(x < 6, 1 / (x * x), 0), np.where(x < 6, x + 1, x)
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def _next_alpha(alpha: np.ndarray, mean_log: np.ndarray, n: float, weight: float) -> np.ndarray:
    """A Newton step towards the prior under which the documents' topics are most likely."""
    gradient = n * (S.digamma(alpha.sum(keepdims=True)) - S.digamma(alpha) + mean_log)
    c, q = n * _trigamma(alpha.sum(keepdims=True))[0], -n * _trigamma(alpha)
    b = (gradient / q).sum() / (1 / c + (1 / q).sum())
    new = alpha - weight * (gradient - b) / q
    return new if (new > 0).all() else alpha


def expected_weights(matrix: np.ndarray) -> np.ndarray:
    """How likely each term is in each topic, up to a factor, under Dirichlet weights by term and topic."""
    out, of_topics = np.empty_like(matrix), S.digamma(matrix.sum(axis=0))
    for low in range(0, len(matrix), PIECE_TERMS):
        out[low : low + PIECE_TERMS] = np.exp(S.digamma(matrix[low : low + PIECE_TERMS]) - of_topics)
    return out


def train_online(
    documents: DataFrame,
    num_terms: int,
    num_topics: int,
    maxIter: int = 20,
    docConcentration: float | list[float] | None = None,
    topicConcentration: float | None = None,
    subsamplingRate: float = 1.0,
    learningOffset: float = 1024.0,
    learningDecay: float = 0.51,
    optimizeDocConcentration: bool = True,
    seed: int = 1,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Dirichlet weights by term and topic, the topics' prior and that of terms."""
    spark = documents.sparkSession
    alpha = _concentrations(docConcentration, num_topics, 1 / num_topics)
    eta = 1 / num_topics if topicConcentration is None else topicConcentration
    matrix = np.random.default_rng(seed).gamma(GAMMA_SHAPE, 1 / GAMMA_SHAPE, (num_terms, num_topics))
    size = documents.count()
    few, names = _few(documents), [f"v{k}" for k in range(num_topics)]
    for step in range(1, maxIter + 1):
        sent = spark.sparkContext.broadcast((expected_weights(matrix), alpha))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent, step=step) -> Iterator[pa.RecordBatch]:
            weights, alpha = sent.value
            sums, logs, documents = np.zeros_like(weights), np.zeros(len(alpha)), 0
            for batch in batches:
                keys, codes, n, bounds = _arrays(batch)
                times = _drawn(keys, subsamplingRate, seed, step)
                chosen = np.repeat(times, np.diff(bounds)) > 0
                own = np.concatenate(([0], np.cumsum(np.diff(bounds)[times > 0])))
                times = times[times > 0]
                gamma = S.variational(codes[chosen], n[chosen], own, weights, alpha, sums, times)
                logs += (times[:, None] * (S.digamma(gamma) - S.digamma(gamma.sum(axis=1, keepdims=True)))).sum(axis=0)
                documents += int(times.sum())
            for numbers, columns in sent_sums(sums, logs, documents):
                yield pa.RecordBatch.from_arrays([pa.array(numbers), *columns], names=["code", *names])

        rows = few.mapInArrow(expect, "code long, " + ", ".join(f"{name} long" for name in names))
        sums, logs, drawn = _added(rows, num_terms, num_topics)
        sent.destroy()
        if not drawn:
            continue
        rate = (learningOffset + step) ** -learningDecay
        sums *= size / np.ceil(subsamplingRate * size)
        sums += eta
        sums *= rate
        matrix *= 1 - rate
        matrix += sums
        if optimizeDocConcentration:
            alpha = _next_alpha(alpha, logs / drawn, drawn, rate)
    return matrix, alpha, eta


def _em_step(kind: Callable, size: int, num_topics: int) -> Callable:
    """Documents with their new topic counts, and the sums of the task by term."""
    names = [f"v{k}" for k in range(num_topics)]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, documents = np.zeros((size, num_topics)), 0
        for batch in batches:
            keys, codes, n, bounds = _arrays(batch)
            gamma = np.zeros((len(keys), num_topics))
            topics = batch.column("topics").flatten().to_numpy().reshape(-1, num_topics) if "topics" in batch.schema.names else None
            cuts = np.flatnonzero(np.diff(bounds[:-1] // S.ENTRIES)) + 1
            for low, high in zip((0, *cuts), (*cuts, len(keys)), strict=True):
                own = slice(bounds[low], bounds[high])
                owner = np.repeat(np.arange(low, high), np.diff(bounds)[low:high])
                shares = kind(keys, codes[own], owner, topics)
                shares *= (n[own] / (shares.sum(axis=1) + 1e-100))[:, None]
                S.add_by_code(gamma, owner, shares)
                S.add_by_code(sums, codes[own], shares)
            documents += len(keys)
            every = np.arange(len(keys) + 1, dtype=np.int32) * num_topics
            lists = pa.ListArray.from_arrays(pa.array(every), pa.array(gamma.ravel()))
            nulls = [pa.nulls(len(keys), pa.int64())] * (num_topics + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(keys), dtype=np.int32)), batch.column("key"), batch.column("codes"), batch.column("n"), lists, *nulls],
                names=["kind", "key", "codes", "n", "topics", "code", *names],
            )
        for numbers, columns in sent_sums(sums, np.zeros(num_topics), documents):
            none = [pa.nulls(len(numbers), form) for form in (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(numbers), dtype=np.int32)), *none, pa.array(numbers), *columns],
                names=["kind", "key", "codes", "n", "topics", "code", *names],
            )

    return step


def train_em(
    documents: DataFrame,
    num_terms: int,
    num_topics: int,
    maxIter: int = 20,
    docConcentration: float | list[float] | None = None,
    topicConcentration: float | None = None,
    seed: int = 1,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Counts by term and topic, the topics' prior and that of terms; priors are greater than 1."""
    spark = documents.sparkSession
    alpha = _concentrations(docConcentration, num_topics, 50 / num_topics + 1)
    eta = 1.1 if topicConcentration is None else topicConcentration
    if (alpha <= 1).any() or eta <= 1:
        raise ValueError("em needs docConcentration and topicConcentration above 1")
    state = "kind int, key long, codes array<int>, n array<double>, topics array<double>, code long, "
    state += ", ".join(f"v{k} long" for k in range(num_topics))
    matrix, path = np.zeros((num_terms, num_topics)), None

    def begin(keys: np.ndarray, codes: np.ndarray, owner: np.ndarray, topics: None) -> np.ndarray:
        entries = _mixed(keys, seed)[owner] ^ _mixed(codes, seed + 1)
        return np.stack([_uniform(entries, k) for k in range(num_topics)], axis=1)

    for step in range(maxIter + 1):
        sent = spark.sparkContext.broadcast((matrix + eta - 1) / (matrix.sum(axis=0) + num_terms * (eta - 1)) if step else None)

        def expect(keys: np.ndarray, codes: np.ndarray, owner: np.ndarray, topics: np.ndarray, sent=sent) -> np.ndarray:
            return sent.value[codes] * (topics[owner] + alpha - 1)

        found = _few(documents).mapInArrow(_em_step(expect if step else begin, num_terms, num_topics), state)
        before, path = path, scratch_path(spark, "em_state")
        found.write.partitionBy("kind").parquet(path)
        rows = spark.read.schema(state).parquet(path)
        matrix = _added(rows.where("kind = 1"), num_terms, num_topics)[0]
        documents = rows.where("kind = 0").select("key", "codes", "n", "topics")
        sent.destroy()
        if before:
            drop_path(spark, before)
    drop_path(spark, path)
    return matrix, alpha, eta

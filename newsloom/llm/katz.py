"""Katz backoff language model: train on part of a corpus and score all of it.

Counts of n-grams are discounted by Good-Turing; what the discounts leave over in a context is given to
the n-grams of the next lower order that were not seen there, with backoff weights that make the
probabilities of every context sum to 1 exactly. Below the words stands one class for all unknown words.
The probability of a token is found recursively: its n-gram if that was seen, else the backoff weight of
its context times its probability at the next lower order.

The counts of each order are a table partitioned by context. Documents are held in blocks. For each
order, every block sends the distinct n-grams it has, with its counts, to the partitions; each partition
adds up its n-grams over all blocks and answers every block in the order asked, with counts and sums of
contexts. So an n-gram of a block moves once however often it occurs there, no table is sent to all
tasks, and the sums of a block stay in the block. Frequent contexts are spread over all partitions by
their next word; their sums are added up apart, a bounded number of them, and sent to all.

Blocks and requests are pair RDDs: blocks keep their partitioning over all orders and meet the answers
without being moved again, which DataFrames cannot state. Lost partitions are rebuilt by lineage from
shuffle files and the input.

Null and empty texts have one token, the end. Rows without an id are held out. Repeated rows count
repeatedly. With nothing to train on, all tokens are unknown with probability 1. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.text import mix, pieces, words

ORDER = 2
# Counts up to this one are discounted.
DISCOUNTED = 5
BLOCK_BYTES = 8 << 20
END = np.uint64(0x1F0E0D0C0B0A0908)
START = np.uint64(0x0102030405060708)
BASE_SMOOTHING = 0.1
# A context with more than this share of what a partition holds on average is spread.
SPREAD_SHARE = 0.25
# Stands for no context among the statistics.
COUNTS = -1


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each compressed on its own; the first bytes of all numbers, then the second
    ones, and so on."""
    out = []
    for x in arrays:
        data = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""
        out.append((x.dtype.str, len(x), pa.compress(data, codec="zstd", asbytes=True) if data else b""))
    return pickle.dumps(out, protocol=5)


def _unpack(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, packed in pickle.loads(data):
        width = np.dtype(kind).itemsize
        planes = pa.decompress(packed, decompressed_size=n * width, codec="zstd", asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(kind).reshape(n))
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of sorted hashes, which have fewer bytes than the hashes; sums give them back."""
    return np.diff(ascending, prepend=np.uint64(0))


@dataclass
class Block:
    """Documents as indexes into the words of the block, each with an end."""

    vocabulary: np.ndarray
    tokens: np.ndarray
    bounds: np.ndarray
    doc_ids: np.ndarray
    has_id: np.ndarray
    held_out: np.ndarray

    def pack(self) -> bytes:
        return _pack(_steps(self.vocabulary), self.tokens.astype(np.uint32), self.bounds, self.doc_ids, self.has_id, self.held_out)

    @staticmethod
    def unpack(data: bytes) -> Block:
        steps, *rest = _unpack(data)
        return Block(np.cumsum(steps, dtype=np.uint64), *rest)

    @property
    def trains(self) -> np.ndarray:
        """Whether each token belongs to a training document."""
        return np.repeat(~self.held_out, np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        return self.vocabulary[self.tokens]

    def contexts(self, order: int) -> np.ndarray:
        """A hash of the ``order - 1`` tokens before each token; starts stand before a document."""
        own = self.hashes()
        place = np.arange(len(own)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))
        out = np.zeros(len(own), dtype=np.uint64)
        for back in range(1, order):
            before = np.concatenate((np.full(back, START), own[:-back] if back < len(own) else own[:0]))[: len(own)]
            before = np.where(place >= back, before, START)
            out = mix(out ^ before, back)
        return out


@dataclass
class Keys:
    """The distinct n-grams of a block at one order, by partition and context."""

    of_token: np.ndarray
    context: np.ndarray
    word: np.ndarray
    count: np.ndarray
    spread: np.ndarray
    partition: np.ndarray
    first: np.ndarray


def _keys(block: Block, order: int, partitions: int, spread: np.ndarray) -> Keys:
    """``spread`` says for each token whether its context is a frequent one."""
    contexts, hashes = block.contexts(order), block.hashes()
    _, first, of_token = np.unique(mix(contexts, 31) ^ mix(hashes, 32), return_index=True, return_inverse=True)
    count = np.bincount(of_token[block.trains], minlength=len(first))
    context, word, wide = contexts[first], hashes[first], spread[first]
    home = np.where(wide, mix(context ^ mix(word, 33), 34), mix(context, 34))
    partition = (home % np.uint64(partitions)).astype(np.int64)
    order_ = np.lexsort((word, context, partition))
    place = np.empty(len(order_), dtype=np.int64)
    place[order_] = np.arange(len(order_))
    return Keys(place[of_token], context[order_], word[order_], count[order_], wide[order_], partition[order_], first[order_])


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours start."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def _requests(number: int, keys: Keys, lower: np.ndarray, partitions: int) -> Iterator[tuple[int, tuple[int, bytes]]]:
    """Per partition: contexts with the lengths of their runs, words, counts and lower probabilities."""
    cuts = np.searchsorted(keys.partition, np.arange(partitions + 1)).tolist()
    for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if b > a:
            starts = _runs(keys.context[a:b])
            lengths = np.diff(np.append(starts, b - a)).astype(np.uint32)
            # Within a context the first 48 bits tell words apart. Many contexts share words, which the
            # compression finds as rows of six bytes; in one context they are sorted and differ little.
            word = keys.word[a:b] >> np.uint64(16)
            if len(starts) > 1:
                word = word.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].reshape(-1)
            values, which = np.unique(lower[a:b], return_inverse=True)
            count = keys.count[a:b].astype(np.uint32)
            packed = _pack(_steps(keys.context[a:b][starts]), keys.spread[a:b][starts], lengths, word, count, values, which.astype(np.uint32))
            yield p, (number, packed)


@dataclass
class Table:
    """The n-grams of a partition over all blocks."""

    numbers: list[int]
    sizes: list[int]
    of_request: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    spread: np.ndarray
    of_context: np.ndarray
    request_contexts: np.ndarray
    request_runs: list[int]
    sums: np.ndarray

    @staticmethod
    def merge(items: Iterable[tuple[int, tuple[int, bytes]]]) -> Table | None:
        numbers, parts = [], []
        for _, (number, data) in items:
            steps, *part, values, which = _unpack(data)
            numbers.append(number)
            spread, lengths, word, count = part
            if word.dtype == np.uint8:
                word = np.pad(word.reshape(-1, 6), ((0, 0), (0, 2))).view("<u8").ravel()
            parts.append((np.cumsum(steps, dtype=np.uint64), spread, lengths, word, count, values[which]))
        if not numbers:
            return None
        starts, wide, lengths, word, count, lower = (np.concatenate(x) for x in zip(*parts, strict=True))
        context = np.repeat(starts, lengths)
        _, first, of_request = np.unique(mix(context ^ mix(word, 36), 37), return_index=True, return_inverse=True)
        counts = np.bincount(of_request, weights=count, minlength=len(first)).astype(np.int64)
        contexts, of_context = np.unique(starts, return_inverse=True)
        spread = np.zeros(len(contexts), dtype=bool)
        spread[of_context] = wide
        owner = np.repeat(of_context, lengths)[first]
        sums = _context_sums(owner, counts, lower[first], len(contexts))
        return Table(numbers, [len(p[3]) for p in parts], of_request, counts, contexts, spread, owner, of_context, [len(p[0]) for p in parts], sums)

    def statistics(self) -> Iterator[tuple[object, np.ndarray]]:
        """How many n-grams have each count, and the part of the sums of frequent contexts."""
        yield COUNTS, np.bincount(np.minimum(self.counts, DISCOUNTED + 2), minlength=DISCOUNTED + 3).astype(float)
        for i in np.flatnonzero(self.spread).tolist():
            yield int(self.contexts[i]), self.sums[i]

    def replies(self, level: int) -> Iterator[tuple[int, tuple[int, int, bytes]]]:
        partition = TaskContext.get().partitionId()
        a = c = 0
        for number, size, runs in zip(self.numbers, self.sizes, self.request_runs, strict=True):
            counts = self.counts[self.of_request[a : a + size]].astype(np.uint32)
            sums = self.sums[self.request_contexts[c : c + runs]]
            whole = (sums[:, j].astype(np.int64) for j in range(DISCOUNTED + 1))
            yield number, (level, partition, _pack(counts, *whole, sums[:, DISCOUNTED + 1]))
            a, c = a + size, c + runs


def _context_sums(owner: np.ndarray, counts: np.ndarray, lower: np.ndarray, n: int) -> np.ndarray:
    """Per context: tokens, n-grams with count 1, 2, ..., and the lower probability of those seen."""
    seen = counts > 0
    columns = [np.bincount(owner, weights=counts, minlength=n)]
    columns += [np.bincount(owner[counts == r], minlength=n).astype(float) for r in range(1, DISCOUNTED + 1)]
    columns.append(np.bincount(owner[seen], weights=lower[seen], minlength=n))
    return np.stack(columns, axis=1)


def discounts(with_count: np.ndarray) -> np.ndarray:
    """Factors for counts from 0 to ``DISCOUNTED + 1`` by Good-Turing; ``with_count[r]`` n-grams occur
    r times. Where these leave no proper factors, a constant is taken off every discounted count."""
    factors = np.ones(DISCOUNTED + 2)
    n = with_count
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.arange(1, DISCOUNTED + 1)
        tail = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1]
        turing = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail)
    if np.all(np.isfinite(turing)) and np.all(turing > 0) and np.all(turing < 1):
        factors[1:-1] = turing
    else:
        off = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 and n[2] > 0 else 0.5
        factors[1:-1] = (r - off) / r
    return factors


@dataclass
class Level:
    """What is known of an order beside its table: discounts and the sums of frequent contexts."""

    factors: np.ndarray
    contexts: np.ndarray
    sums: np.ndarray


def _context_terms(sums: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each context: what counts are divided by, and its backoff weight."""
    total = sums[:, 0]
    kept = total - sums[:, 1 : DISCOUNTED + 1] @ (np.arange(1, DISCOUNTED + 1) * (1 - factors[1:-1]))
    # Where nothing was discounted one more token is imagined, so that something is left over.
    divisor = np.where(kept >= total, total + 1, total)
    backoff = (1 - kept / divisor) / (1 - sums[:, DISCOUNTED + 1])
    return divisor, np.where(total > 0, backoff, 1.0)


def _frequent(sums: np.ndarray, contexts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(contexts, wanted), max(len(contexts) - 1, 0))
    return sums[at]


@dataclass
class Model:
    """What all blocks know: levels, number of types, and how frequent a context is to be spread."""

    levels: list[Level]
    types: int
    limit: float
    partitions: int


def evaluate(block: Block, model: Model, replies: list[tuple[int, int, bytes]]):
    """Counts of all tokens of a block by order, their probabilities, and which contexts are spread."""
    lower = np.full(len(block.tokens), 1.0 / (model.types + 1))
    spread = np.ones(len(block.tokens), dtype=bool)
    counts = []
    for order, level in enumerate(model.levels, start=1):
        keys = _keys(block, order, model.partitions, spread)
        got = [_unpack(data) for _, data in sorted((p, data) for of, p, data in replies if of == order)]
        count = np.concatenate([np.zeros(0, np.uint32), *(g[0] for g in got)]).astype(np.int64)
        runs = _runs_of(keys)
        sums = np.concatenate([np.zeros((0, DISCOUNTED + 2)), *(np.stack(g[1:], axis=1) for g in got)])
        lengths = np.diff(np.append(runs, len(keys.context)))
        wide = keys.spread[runs]
        if wide.any():
            sums[wide] = _frequent(level.sums, level.contexts, keys.context[runs][wide])
        divisor, backoff = (np.repeat(x, lengths) for x in _context_terms(sums, level.factors))
        seen = level.factors[np.minimum(count, DISCOUNTED + 1)] * count / divisor
        probability = np.where(count > 0, seen, backoff * lower[keys.first])
        lower = probability[keys.of_token]
        own = count[keys.of_token]
        counts.append(own)
        starts = np.zeros(len(own), dtype=bool)
        starts[block.bounds[:-1]] = True
        before = np.concatenate(([0], own[:-1]))
        spread = starts | (before >= model.limit)
    return counts, lower, spread


def _runs_of(keys: Keys) -> np.ndarray:
    """Where runs of one context within one partition start."""
    if not len(keys.context):
        return np.zeros(0, np.int64)
    new = (keys.context[1:] != keys.context[:-1]) | (keys.partition[1:] != keys.partition[:-1])
    return np.flatnonzero(np.concatenate(([True], new)))


def _with_held_out(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, held_out)``."""
    doc_id = F.col("doc_id").cast("long")
    remainder = F.crc32(doc_id.cast("string").cast("binary")) % 10
    held_out = F.coalesce(remainder, F.lit(0)) == 0
    return docs.select(doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), held_out.alias("held_out"))


def _blocks(rows: DataFrame):
    """Pairs of a block number and a packed block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in pieces(batches, 1, BLOCK_BYTES):
            hashes, bounds = words(batch.column(1))
            n = batch.num_rows
            ends = bounds + np.arange(n + 1)
            tokens = np.full(len(hashes) + n, END)
            tokens[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(bounds))] = hashes
            vocabulary, tokens = np.unique(tokens, return_inverse=True)
            ids = batch.column(0)
            held_out = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            has_id = ids.is_valid().to_numpy(zero_copy_only=False)
            block = Block(vocabulary, tokens, ends, ids.fill_null(0).to_numpy(), has_id, held_out)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([block.pack()])], names=["block", "data"])
            number += 1

    return rows.mapInArrow(build, "block long, data binary").rdd.map(lambda r: (r["block"], bytes(r["data"])))


FIELDS = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
    "score double"
)


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Train on the documents whose ``crc32(doc_id) % 10`` is not 0 and score all.

    ``score`` is the log10 probability under the model, ``base_score`` that under smoothed unigrams.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _with_held_out(docs)
    if not rows.agg(F.count("doc_id") + F.count("*")).first()[0]:
        return spark.createDataFrame([], FIELDS)
    blocks = _blocks(rows).partitionBy(partitions)
    model = Model([], 0, math.inf, partitions)
    answers = None
    train_tokens = 0
    for level in range(1, order + 1):
        sent = context.broadcast(model)
        table = _ask(_meet(blocks, answers, partitions), sent, level).partitionBy(partitions, int)
        found = table.mapPartitions(_statistics).reduceByKey(lambda a, b: a + b, partitions).collectAsMap()
        with_count = found.pop(COUNTS, np.zeros(DISCOUNTED + 3))
        names = np.array(sorted(found), dtype=np.uint64)
        sums = np.array([found[k] for k in sorted(found)]).reshape(len(names), DISCOUNTED + 2)
        if level == 1:
            types = int(with_count[1:].sum())
            train_tokens = int(sums[:, 0].sum())
            sums[:, DISCOUNTED + 1] = types / (types + 1)
            model = Model([], types, max(2.0, SPREAD_SHARE * train_tokens / partitions), partitions)
        known = Level(discounts(with_count), names, sums)
        model = Model([*model.levels, known], model.types, model.limit, partitions)
        answered = table.mapPartitions(lambda items, level=level: _reply(items, level)).partitionBy(partitions)
        answers = answers.union(answered) if answers is not None else answered
    sent = context.broadcast(model)
    scored = _meet(blocks, answers, partitions).flatMap(lambda x: _score(x[1], sent.value, train_tokens))
    return spark.createDataFrame(scored, FIELDS)


def _statistics(items):
    table = Table.merge(items)
    return table.statistics() if table else iter(())


def _reply(items, level: int):
    table = Table.merge(items)
    return table.replies(level) if table else iter(())


def _meet(blocks, answers, partitions: int):
    """Blocks with the answers to all their questions so far; nothing is moved."""
    if answers is None:
        return blocks.mapValues(lambda data: (data, []))
    return blocks.cogroup(answers, partitions).mapValues(lambda v: (next(iter(v[0])), list(v[1])))


def _ask(met, sent, level: int):
    def ask(item):
        number, (data, got) = item
        model = sent.value
        block = Block.unpack(data)
        _, lower, spread = evaluate(block, model, got)
        keys = _keys(block, level, model.partitions, spread)
        return _requests(number, keys, lower[keys.first], model.partitions)

    return met.flatMap(ask)


def _score(value: tuple[bytes, list], model: Model, train_tokens: int) -> Iterator[tuple]:
    data, got = value
    block = Block.unpack(data)
    counts, probability, _ = evaluate(block, model, got)
    rows = np.repeat(np.arange(len(block.doc_ids)), np.diff(block.bounds))
    n = len(block.doc_ids)
    base = np.log10((counts[0] + BASE_SMOOTHING) / (train_tokens + BASE_SMOOTHING * (model.types + 1)))
    columns = [
        block.held_out.tolist(),
        np.diff(block.bounds).tolist(),
        np.bincount(rows, weights=counts[0] > 0, minlength=n).astype(np.int64).tolist(),
        [train_tokens] * n,
        np.bincount(rows, weights=base, minlength=n).tolist(),
        np.bincount(rows, weights=np.log10(probability), minlength=n).tolist(),
    ]
    ids = [i if has else None for i, has in zip(block.doc_ids.tolist(), block.has_id.tolist(), strict=True)]
    return zip(ids, *columns, strict=True)

"""Token counts of documents in flat token files without an index.

A token file is a stream of fixed-width ids; each document is followed by a separator id. Blocks of a
file are searched for separators on their own, as whole arrays. A document may span blocks, so the
counts are stitched by a prefix scan over one summary row per block: the stream position of the block,
the number of separators before it and the position after the last of these. The scan has two levels,
so that no task gets all blocks of a long file.

Empty documents (two separators in a row) have 0 tokens. Tokens after the last separator of a file are
a document of their own. An empty file or table has no documents. Null payloads are empty blocks. A
payload that cuts an id in two is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions.staging import scratch_path
from newsloom.llm.text import words

SEPARATOR = 0
WIDTH = 2
BLOCK_TOKENS = 1 << 16
# Blocks whose summaries are scanned together.
SUPERBLOCK = 1 << 12


def read_token_files(spark: SparkSession, path: str, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks ``(file, block, payload)`` of binary token files; a task reads one file at a time, so
    files should be shards of at most some hundred MB."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = width * block_tokens
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                parts = [data.slice(i, min(step, data.size - i)).to_pybytes() for i in range(0, data.size, step)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())],
                    names=["file", "block", "payload"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(blocks, "file string, block long, payload binary")


def tokenise_to_blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Write one token stream per input partition to the shared folder.

    Tokens are words, hashed to ids from 1 to 65,535. Returns the blocks ``(file, block, payload)`` and
    the documents ``(file, ordinal, doc_id)`` in stream order; the blocks themselves name no documents.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, ordinal = str(TaskContext.get().partitionId()), 0, 0
        rest = np.zeros(0, dtype="<u2")

        def rows(stream: np.ndarray, first: int) -> pa.RecordBatch:
            parts = [stream[i : i + block_tokens].tobytes() for i in range(0, len(stream), block_tokens)]
            n = len(parts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(["tokens"] * n, pa.string()),
                    pa.array([file] * n, pa.string()),
                    pa.array(range(first, first + n), pa.int64()),
                    pa.array(parts, pa.binary()),
                    pa.nulls(n, pa.int64()),
                ],
                names=["part", "file", "block", "payload", "doc_id"],
            )

        for batch in batches:
            n = batch.num_rows
            hashes, bounds = words(batch.column(1))
            stream = np.full(len(hashes) + n, SEPARATOR, dtype="<u2")
            stream[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(bounds))] = 1 + hashes % np.uint64(65_535)
            stream = np.concatenate((rest, stream))
            whole = len(stream) // block_tokens * block_tokens
            yield rows(stream[:whole], block)
            block += whole // block_tokens
            rest = stream[whole:]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["documents"] * n, pa.string()),
                    pa.array([file] * n, pa.string()),
                    pa.array(range(ordinal, ordinal + n), pa.int64()),
                    pa.nulls(n, pa.binary()),
                    batch.column(0),
                ],
                names=["part", "file", "block", "payload", "doc_id"],
            )
            ordinal += n
        yield rows(rest, block)

    spark = docs.sparkSession
    path = scratch_path(spark, "token_stream")
    schema = "part string, file string, block long, payload binary, doc_id long"
    texts = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    streams = docs.select(F.col("doc_id").cast("long").alias("doc_id"), texts).mapInArrow(write, schema)
    streams.write.partitionBy("part").parquet(path)
    fields = "file string, block long, payload binary, doc_id long, part string"
    table = spark.read.schema(fields).parquet(path)
    blocks = table.where("part = 'tokens'").select("file", "block", "payload")
    documents = table.where("part = 'documents'").select("file", F.col("block").alias("ordinal"), "doc_id")
    return blocks, documents


def scan_blocks(blocks: DataFrame, separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """Per block: its number of ids, where its last document ends, and the lengths between separators.

    The first length counts from the start of the block and is completed by the stitching.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, lengths = [], [], []
            for payload in batch.column(2):
                data = payload.as_py() or b""
                if len(data) % width:
                    raise ValueError(f"a block of {len(data)} bytes cuts an id of {width} bytes in two")
                at = np.flatnonzero(np.frombuffer(data, dtype=f"<u{width}") == separator)
                sizes.append(len(data) // width)
                ends.append(int(at[-1]) + 1 if len(at) else None)
                lengths.append(np.diff(at, prepend=-1) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(ends, pa.int64()),
                    pa.array(lengths, pa.list_(pa.int64())),
                ],
                names=["file", "block", "size", "last_end", "lengths"],
            )

    schema = "file string, block long, size long, last_end long, lengths array<long>"
    return blocks.select("file", "block", "payload").mapInArrow(scan, schema)


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """One row ``(file, ordinal, n_tokens)`` per document, in the order of the stream from 0."""
    before = Window.partitionBy("file", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = (
        scan_blocks(blocks, separator, width)
        .withColumn("super", F.expr(f"block div {SUPERBLOCK}"))
        .withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("seen", F.coalesce(F.sum(F.size("lengths")).over(before), F.lit(0)))
        .withColumn("open", F.max(F.col("start") + F.col("last_end")).over(before))
    )
    earlier = Window.partitionBy("file").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    groups = (
        inside.groupBy("file", "super")
        .agg(
            F.sum("size").alias("size"),
            F.sum(F.size("lengths")).alias("separators"),
            F.max(F.col("start") + F.col("last_end")).alias("last_end"),
            F.max("block").alias("last_block"),
        )
        .withColumn("base", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .withColumn("base_seen", F.coalesce(F.sum("separators").over(earlier), F.lit(0)))
        .withColumn("base_open", F.coalesce(F.max(F.col("base") + F.col("last_end")).over(earlier), F.lit(0)))
        .withColumn("is_last", F.lead("super").over(Window.partitionBy("file").orderBy("super")).isNull())
        .select("file", "super", "base", "base_seen", "base_open", "is_last", "last_block")
    )
    rest = F.col("size") - F.coalesce("last_end", F.lit(0))
    unfinished = F.col("is_last") & (F.col("block") == F.col("last_block"))
    unfinished &= (rest > 0) | (F.col("last_end").isNull() & (F.col("carry") > 0))
    documents = (
        inside.join(groups, ["file", "super"])
        .withColumn("carry", F.col("base") + F.col("start") - F.coalesce(F.col("base") + F.col("open"), "base_open"))
        .withColumn("lengths", F.when(unfinished, F.concat("lengths", F.array(rest))).otherwise(F.col("lengths")))
        .select("file", (F.col("base_seen") + F.col("seen")).alias("seen"), "carry", F.posexplode("lengths").alias("k", "n"))
    )
    return documents.select(
        "file",
        (F.col("seen") + F.col("k")).alias("ordinal"),
        (F.col("n") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"),
    )


def document_token_counts(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens)`` of every document, counted in the token stream made of them."""
    blocks, documents = tokenise_to_blocks(docs)
    return documents.join(count_tokens(blocks), ["file", "ordinal"]).select("doc_id", "n_tokens")

"""Article texts, work lists and manifests of ids already handled."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.ml.common import _java2py
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.staging import path_exists

ID_FILE_PATTERN = r"([0-9]+)\.txt$"


def read_text_folder(
    spark: SparkSession, path: str, id_pattern: str = ID_FILE_PATTERN, encoding: str = "utf8"
) -> DataFrame:
    """``(id, text)`` with one row per file; the id is the first group of ``id_pattern``.

    Bytes that are not of the encoding fail the job rather than being replaced. Spark's file sources
    skip files of length zero, so empty files come from the list of files, which Spark makes on the
    driver: an id with empty files only has an empty text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    texts = files.select(
        F.regexp_extract("path", id_pattern, 1).cast("long").alias("id"),
        _decoded(F.col("content"), encoding).alias("text"),
    )
    # The names pass from the JVM at once; ``inputFiles`` makes a call for each.
    names = _java2py(spark.sparkContext, files._jdf.inputFiles())
    listed = {int(found[1]) for name in names if (found := re.search(id_pattern, name)) and found[1]}
    if not listed:
        return texts
    ids = spark.createDataFrame(pd.DataFrame({"id": sorted(listed)}))
    with_content = files.select(F.regexp_extract("path", id_pattern, 1).cast("long").alias("id"))
    empty = ids.join(with_content, "id", "left_anti").select("id", F.lit("").alias("text"))
    return texts.unionByName(empty)


def write_text_folder(texts: DataFrame, path: str, end: str = "\n") -> None:
    """Write ``(id, text)`` as files ``id=<id>.txt`` in the folders of the tasks, each text followed by ``end``.

    Texts of one id share a file; a null id has the name ``null`` and a null text is empty. Tasks write the files
    themselves, to a folder that pyarrow can write to, because Spark's writer would make and move a folder for
    each document. A task that is repeated writes the same files again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(path)
        last, held, folder, n = None, [], None, 0

        def store() -> None:
            with files.open_output_stream(f"{folder}/id={'null' if last is None else last}.txt") as out:
                out.write(b"".join(held))

        for batch in batches:
            for id_, part, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if held and id_ != last:
                    store()
                    held.clear()
                if folder is None:
                    folder = f"{root.rstrip('/')}/{part:05d}"
                    files.create_dir(folder, recursive=True)
                held += (text, end.encode())
                last, n = id_, n + 1
        if held:
            store()
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    conf = texts.sparkSession.conf
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), texts.sparkSession.sparkContext.defaultParallelism)
    dealt = texts.repartition(parts, "id").sortWithinPartitions("id")
    rows = dealt.select("id", F.spark_partition_id(), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def _decoded(content: Column, encoding: str) -> Column:
    if encoding.lower().replace("-", "") == "utf8":
        return F.validate_utf8(content.cast("string"))
    return F.decode(content, encoding)


def clustered_by_id(rows: DataFrame) -> DataFrame:
    """Sorted by id within ranges of ids, so that stored rows can be looked up by id.

    Spark evaluates its input twice for this, first to find the ranges: cluster stored
    rows and compute on them afterwards, which keeps the order.
    """
    return rows.repartitionByRange("id").sortWithinPartitions("id")


def write_articles(articles: DataFrame, path: str, clustered: bool = True) -> None:
    rows = articles.select("id", "text")
    (clustered_by_id(rows) if clustered else rows).write.mode("overwrite").parquet(path)


def read_work_list(spark: SparkSession, path: str) -> DataFrame:
    """``(id, url)`` from text lines of at least two blank-separated fields."""
    fields = F.split(F.trim("value"), r"\s+")
    return (
        spark.read.text(path)
        .where(F.length(F.trim("value")) > 0)
        .select(fields[0].cast("long").alias("id"), fields[1].alias("url"))
    )


def read_manifest(spark: SparkSession, path: str, without: str | None = None) -> DataFrame:
    """Ids already done, but for those of the folder ``without``; a missing file means none."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "id long")
    ids = spark.read.schema("id long").csv(path)
    if without is not None:
        ids = ids.where(~F.contains(F.input_file_name(), F.lit(f"/{without}/")))
    return ids.select("id")


def append_ids(ids: DataFrame, path: str) -> None:
    ids.select("id").write.mode("append").csv(path)

"""Files that an external topic model trainer exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_topic_keys_file(spark: SparkSession, path: str) -> DataFrame:
    """``(topic_id, alpha, words)`` from lines of topic, alpha and blank-separated words."""
    keys = spark.read.csv(path, sep="\t", schema="topic_id int, alpha double, words string", quote="")
    return keys.withColumn("words", F.split(F.trim("words"), " "))


def read_doc_topics_file(spark: SparkSession, path: str) -> DataFrame:
    """``(id, name, shares)`` from lines of row number, name and one share per topic."""
    fields = F.split(F.rtrim("value"), "\t")
    return (
        spark.read.text(path)
        .where(~F.startswith("value", F.lit("#")))
        .select(
            fields[0].cast("long").alias("id"),
            fields[1].alias("name"),
            F.slice(fields, 3, F.size(fields) - 2).cast("array<double>").alias("shares"),
        )
    )


def read_corpus_file(spark: SparkSession, path: str) -> DataFrame:
    """``(id, label, tokens)`` from lines of id, label and tokens."""
    fields = F.split(F.trim("value"), " ")
    return spark.read.text(path).select(
        fields[0].cast("long").alias("id"),
        fields[1].alias("label"),
        F.slice(fields, 3, F.size(fields) - 2).alias("tokens"),
    )

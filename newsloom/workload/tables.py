"""The test tables, seen as a collection of news articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources.posts import with_created_date
from newsloom.workload import rule_topics

NUM_TOPICS = rule_topics.NUM_TOPICS


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def texts(self) -> DataFrame:
        return self.read("documents").select(F.col("doc_id").alias("id"), "text")

    @property
    def pages(self) -> DataFrame:
        return self.read("pages")

    @property
    def dates(self) -> DataFrame:
        """``(id, created_at, created_date)``; more ids than there are texts."""
        orders = self.read("orders")
        return with_created_date(
            orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
        )

    @property
    def posts(self) -> DataFrame:
        documents = self.read("documents").select(
            F.col("doc_id").alias("id"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.concat(F.lit("http://example.com/"), F.col("doc_id").cast("string")).alias("url"),
        )
        orders = self.read("orders").select(
            F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderdate").alias("created_at")
        )
        customers = self.read("customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("author")
        )
        points = self.read("events").select(
            F.col("event_id").alias("id"),
            F.get_json_object("props", "$.k").cast("int").alias("num_points"),
        )
        joined = documents.join(orders, "id").join(customers, "o_custkey").join(points, "id")
        return with_created_date(joined.select("id", "title", "url", "num_points", "author", "created_at"))

    @property
    def label_ids(self) -> DataFrame:
        return self.read("labels").select(F.col("doc_id").alias("id"))

    @property
    def vectors(self) -> DataFrame:
        return rule_topics.vectors(self.texts)

    @property
    def doc_topics(self) -> DataFrame:
        return rule_topics.doc_topics(self.texts)

    @property
    def topic_words(self) -> DataFrame:
        return rule_topics.topic_words(self.texts)

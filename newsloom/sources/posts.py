"""Post metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSTS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("num_points", T.IntegerType()),
        T.StructField("author", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def with_created_date(posts: DataFrame) -> DataFrame:
    return posts.withColumn("created_date", F.to_date("created_at"))


def read_posts(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    timestamp_format: str | None = None,
) -> DataFrame:
    """Posts from Parquet, or from CSV with a header; no schema inference pass."""
    if format == "parquet":
        return with_created_date(spark.read.parquet(path))
    as_text = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name == "created_at" else f.dataType) for f in POSTS_SCHEMA]
    )
    # Quotes inside a field are doubled, as spreadsheets and pandas write them.
    posts = spark.read.csv(path, schema=as_text, header=True, escape='"', mode="FAILFAST")
    parsed = F.to_timestamp("created_at", timestamp_format) if timestamp_format else F.to_timestamp("created_at")
    return with_created_date(posts.withColumn("created_at", parsed))

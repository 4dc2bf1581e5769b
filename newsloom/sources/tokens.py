"""Token lists, computed once and read back afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.functions.staging import path_is_complete
from newsloom.sources.articles import clustered_by_id


def materialise_tokens(
    spark: SparkSession,
    path: str,
    texts: DataFrame,
    build: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Tokens at ``path``; ``build`` makes them from the texts if no finished copy exists.

    The texts are clustered by id before they are tokenised, so that one id touches one or
    two row groups.
    """
    if not path_is_complete(spark, path):
        build(clustered_by_id(texts)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

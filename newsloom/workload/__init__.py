from newsloom.workload import (  # noqa: F401  (importing registers the queries)
    article_queries,
    cluster_queries,
    feature_queries,
    model_queries,
    similarity_queries,
    source_queries,
    topic_queries,
    trend_queries,
)
from newsloom.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

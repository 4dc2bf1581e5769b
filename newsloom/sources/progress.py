"""Counts of a running job and the rates derived from them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def article_metrics(articles: DataFrame, name: str = "articles") -> tuple[DataFrame, Observation]:
    """The same rows, with article and character counts collected as they pass."""
    observation = Observation(name)
    observed = articles.observe(
        observation,
        F.count(F.lit(1)).alias("articles"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"),
    )
    return observed, observation


def rates(counts: Mapping[str, float], seconds: float) -> dict[str, float]:
    return {f"{name}_per_second": value / max(seconds, 1e-9) for name, value in counts.items()}


def throughput(observation: Observation, seconds: float) -> dict[str, float]:
    """Call after the action; ``get`` waits for it."""
    return rates(observation.get, seconds)

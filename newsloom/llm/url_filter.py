"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

The trees are trained on URLs that a rule judges (or any labelled URLs), on at most ``MAX_LABELLED`` of
them, those that come first in the order of a hash. Features of a URL: lengths, depth of the path, share
of digits, entropy of its characters, number of parameters, labels of the host and statistics of the
host's suffix (smoothed log odds of being blocked, by last label and by the last two).

A null URL, or one without ``://``, has an empty host and path and is judged by the method. If the
labelled URLs are all of one class, that is the verdict; without any the verdict is ``allow``. Repeated
rows get equal verdicts. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.text import batch_bytes

MAX_LABELLED = 20_000
MAX_SUFFIXES = 10_000
TREES = 20
DEPTH = 4
SEED = 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``action`` is allow or block; the host covers its subdomains, the path is a prefix."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def match_rules(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``action``; null if none does. The list
    of rules is part of the plan; of two equally long rules the earlier one wins."""
    best = F.lit(None).cast("struct<rule:string,action:string>")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.text))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        best = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.action).alias("action"))).otherwise(best)
    return best


def _suffixes(host: Column) -> tuple[Column, Column]:
    return F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _lexical(urls: pd.Series, hosts: pd.Series, paths: pd.Series) -> pd.Series:
    """Lengths, share of digits, entropy, depth, parameters, labels of the host, digits of the path."""

    def counts(values: pd.Series) -> np.ndarray:
        data, bounds = batch_bytes(pa.array(values, pa.string()))
        rows = np.repeat(np.arange(len(values)), np.diff(bounds))
        return np.bincount(rows * 256 + data, minlength=256 * len(values)).reshape(len(values), 256)

    if not len(urls):
        return pd.Series([], dtype=object)
    url, host, path = counts(urls), counts(hosts), counts(paths)
    digits = slice(ord("0"), ord("9") + 1)
    size = np.maximum(url.sum(axis=1), 1)
    share = url / size[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    columns = [
        url.sum(axis=1),
        host.sum(axis=1),
        path.sum(axis=1),
        url[:, digits].sum(axis=1) / size,
        entropy,
        path[:, ord("/")],
        url[:, ord("=")],
        url[:, ord("?")],
        url[:, ord("#")],
        host[:, ord(".")],
        host[:, ord("-")],
        path[:, digits].sum(axis=1),
    ]
    return pd.Series(list(np.stack(columns, axis=1).astype(float)))


@dataclass
class UrlModel:
    """Trees, or one verdict for all if there was only one class; and the statistics of suffixes."""

    trees: GBTClassificationModel | None
    verdict: str
    odds: tuple[dict[str, float], dict[str, float]]

    def features(self, url: Column, host: Column, path: Column) -> Column:
        columns = [_lexical(F.coalesce(url, F.lit("")), host, path)]
        for suffix, odds in zip(_suffixes(host), self.odds, strict=True):
            table = F.create_map(*[F.lit(x) for item in odds.items() for x in item]) if odds else None
            value = F.coalesce(F.try_element_at(table, suffix), F.lit(0.0)) if odds else F.lit(0.0)
            columns.append(F.array(value))
        return array_to_vector(F.concat(*columns))


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> UrlModel:
    """Train on ``(url, blocked)``, at most ``max_labelled`` rows of it."""
    sample = (
        labelled.where("blocked is not null")
        .select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("blocked").cast("int").alias("label"))
        .orderBy(F.xxhash64("url"), "url", "label")
        .limit(max_labelled)
        .cache()
    )
    n, blocked = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if blocked in (0, n):
        return UrlModel(None, "block" if blocked else "allow", ({}, {}))
    prior = blocked / n
    odds = []
    for suffix in _suffixes(F.col("host")):
        rows = sample.groupBy(suffix.alias("suffix")).agg(F.count("*").alias("n"), F.sum("label").alias("k"))
        rows = rows.orderBy(F.desc("n"), "suffix").limit(MAX_SUFFIXES).collect()
        smooth = {r["suffix"]: (r["k"] + 10 * prior) / (r["n"] + 10) for r in rows}
        odds.append({s: round(math.log(p / (1 - p)), 6) for s, p in smooth.items()})
    model = UrlModel(None, "allow", (odds[0], odds[1]))
    features = model.features(F.col("url"), F.col("host"), F.col("path")).alias("features")
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=SEED)
    model.trees = trees.fit(sample.select(features, "label"))
    sample.unpersist()
    return model


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, model: UrlModel | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, p_block)``; ``p_block`` is the method's probability."""
    parsed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumn("_match", match_rules(F.col("host"), F.col("path"), rules))
    if model is None:
        model = fit(parsed.select("url", (F.col("_match.action") == "block").alias("blocked")))
    if model.trees is None:
        scored = parsed.withColumn("p_block", F.lit(float(model.verdict == "block")))
    else:
        features = model.features(F.col("url"), F.col("host"), F.col("path"))
        scored = model.trees.transform(parsed.withColumn("features", features))
        scored = scored.withColumn("p_block", F.element_at(vector_to_array(F.col("probability")), 2))
    verdict = F.when(F.col("p_block") > 0.5, "block").otherwise("allow")
    return scored.select(
        "page_id",
        "host",
        "path",
        F.col("_match.rule").alias("rule"),
        F.coalesce("_match.action", verdict).alias("verdict"),
        "p_block",
    )

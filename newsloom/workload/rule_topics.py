"""Topics made by a rule, so that SQL can compute the same shares exactly.

A word gives weight 7 to the topic of its length and 3 to the topic of its first letter.
All sums are integers and are divided once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUM_TOPICS = 10
LENGTH_WEIGHT = 7
LETTER_WEIGHT = 3


def _words(texts: DataFrame) -> DataFrame:
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return texts.select("id", F.explode_outer(found).alias("term")).where("term is not null")


def _length_topic() -> Column:
    return (F.length("term") - 1) % NUM_TOPICS


def _letter_topic() -> Column:
    return (F.ascii("term") - F.ascii(F.lit("a"))) % NUM_TOPICS


def vectors(texts: DataFrame) -> DataFrame:
    """``(id, shares)``; one pass, summed per article before the shuffle."""
    topics = _words(texts).select("id", _length_topic().alias("a"), _letter_topic().alias("b"))
    weight = [
        F.sum(
            F.when(F.col("a") == t, LENGTH_WEIGHT).otherwise(0) + F.when(F.col("b") == t, LETTER_WEIGHT).otherwise(0)
        ).alias(f"w{t}")
        for t in range(NUM_TOPICS)
    ]
    total = ((LENGTH_WEIGHT + LETTER_WEIGHT) * F.count(F.lit(1))).alias("total")
    shares = F.array(*[F.col(f"w{t}").cast("double") / F.col("total").cast("double") for t in range(NUM_TOPICS)])
    return topics.groupBy("id").agg(*weight, total).select("id", shares.alias("shares"))


def doc_topics(texts: DataFrame) -> DataFrame:
    """``(id, topic_id, prob)`` with the shares above zero."""
    return (
        vectors(texts)
        .select("id", F.posexplode("shares").alias("topic_id", "prob"))
        .where("prob > 0")
    )


def topic_words(texts: DataFrame) -> DataFrame:
    """``(topic_id, term, weight)``: the weight a term gives to a topic, over all texts."""
    counts = _words(texts).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    same = _length_topic() == _letter_topic()
    weights = F.when(
        same,
        F.array(F.struct(_length_topic().alias("topic_id"), F.lit(LENGTH_WEIGHT + LETTER_WEIGHT).alias("w"))),
    ).otherwise(
        F.array(
            F.struct(_length_topic().alias("topic_id"), F.lit(LENGTH_WEIGHT).alias("w")),
            F.struct(_letter_topic().alias("topic_id"), F.lit(LETTER_WEIGHT).alias("w")),
        )
    )
    return counts.select("term", "n", F.inline(weights)).select(
        "topic_id", "term", ((F.col("n") * F.col("w")).cast("double") / 10).alias("weight")
    )

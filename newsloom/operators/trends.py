"""Topics over time, time slices and share distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.operators.articles import posts_in, posts_with_text, required
from newsloom.operators.topic_model import MIN_PROB

TREND_WINDOW = 30
COUNT_WINDOW = 5
HISTOGRAM_MIN_PROB = 0.05
HISTOGRAM_BINS = 10


def date_of(timestamp: Column) -> Column:
    return F.to_date(timestamp)


def month_of(timestamp: Column) -> Column:
    return F.to_date(F.date_trunc("month", timestamp))


def centred_mean(value: str, keys: list[str], order: str, window_size: int) -> Column:
    """Mean of ``window_size`` rows around each row, NULL where the window is not full.

    An even window takes one row more before than after. The rows are days, so a series is
    short whatever the number of articles.
    """
    frame = W.partitionBy(*(keys or [F.lit(0)])).orderBy(order).rowsBetween(-(window_size // 2), (window_size - 1) // 2)
    full = F.count(F.lit(1)).over(frame) == window_size
    return F.when(full, F.avg(value).over(frame))


def topic_trends(
    vectors: DataFrame,
    posts: DataFrame,
    topic_ids: int | list[int] | None = None,
    min_prob: float = MIN_PROB,
    window_size: int | None = TREND_WINDOW,
    doc_topics: DataFrame | None = None,
) -> DataFrame:
    """``(topic_id, created_date, value, rolling)``: share sums per day, with a rolling mean.

    Only shares above ``min_prob`` count, and days without such articles have no row. Given
    topics are read from ``doc_topics(id, topic_id, prob)`` if that is at hand, where both
    filters reach the scan; all topics come from the vectors. Articles without a wanted share
    are dropped before the join with the dates, the others are joined as one row each.
    """
    if topic_ids is not None and doc_topics is not None:
        chosen = [topic_ids] if isinstance(topic_ids, int) else list(topic_ids)
        hits = doc_topics.where(F.col("topic_id").isin(chosen) & (F.col("prob") > min_prob))
        dated = hits.select("id", "topic_id", "prob").join(posts.select("id", "created_date"), "id")
        return _rolling(dated, window_size)
    topics = F.transform("shares", lambda share, topic: F.struct(topic.alias("topic_id"), share.alias("prob")))
    wanted = F.filter(topics, lambda t: t["prob"] > min_prob)
    if topic_ids is not None:
        chosen = [topic_ids] if isinstance(topic_ids, int) else list(topic_ids)
        wanted = F.filter(wanted, lambda t: t["topic_id"].isin(chosen))
    dated = (
        vectors.select("id", wanted.alias("topics"))
        .where(F.size("topics") > 0)
        .join(posts.select("id", "created_date"), "id")
        .select("created_date", F.inline_outer("topics"))
        .where("topic_id is not null")
    )
    return _rolling(dated, window_size)


def _rolling(dated: DataFrame, window_size: int | None) -> DataFrame:
    daily = dated.groupBy("topic_id", "created_date").agg(F.sum("prob").alias("value"))
    if window_size is None:
        return daily.withColumn("rolling", F.lit(None).cast("double"))
    return daily.withColumn("rolling", centred_mean("value", ["topic_id"], "created_date", window_size))


def topic_trend_series(trends: DataFrame, labels: DataFrame) -> DataFrame:
    """Trends as chart series: name, words, x and y."""
    name = F.concat(F.lit("Topic #"), F.col("topic_id").cast("string"))
    return trends.join(F.broadcast(labels.select("topic_id", "label")), "topic_id").select(
        "topic_id", name.alias("name"), "label", F.col("created_date").alias("x"), F.col("rolling").alias("y")
    )


def article_counts(posts: DataFrame, ids: DataFrame, window_size: int = COUNT_WINDOW) -> DataFrame:
    """``(created_date, n, rolling)`` for a set of article ids."""
    daily = posts_in(posts.select("id", "created_date"), ids).groupBy("created_date").agg(
        F.count(F.lit(1)).alias("n")
    )
    return daily.withColumn("rolling", centred_mean("n", [], "created_date", window_size))


def time_slices(posts: DataFrame, texts: DataFrame) -> DataFrame:
    """``(month, n)``: articles per month, in time order; the slices add up to the articles.

    An article with two posts would be counted twice and one without a date in no month; either ends the
    query. Both are seen in the counts per id that the months are made from.
    """
    dated = posts_with_text(posts.select("id", "created_at"), texts).groupBy("id")
    single = dated.agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("created_at"))
    broken = (F.col("n") > 1) | F.col("created_at").isNull()
    checked = single.where(required(broken, "article ", F.col("id").cast("string"), " has no single date"))
    return checked.groupBy(month_of(F.col("created_at")).alias("month")).agg(F.count(F.lit(1)).alias("n")).orderBy("month")


def ids_by_time(posts: DataFrame, texts: DataFrame, max_count: int | None = None) -> DataFrame:
    """``(id, created_at)`` of articles with a text, oldest first."""
    ordered = posts_with_text(posts.select("id", "created_at"), texts).orderBy("created_at", "id")
    return ordered if max_count is None else ordered.limit(max_count)


def by_time(table: DataFrame, posts: DataFrame, max_count: int | None = None) -> DataFrame:
    """Rows of ``table`` (tokens or bags of words) with their date and the number of their month.

    Months are numbered from 0 in a table with one row per month. ``max_count`` takes the
    first rows in the order of time; only their ids are sorted.
    """
    if max_count is not None:
        first = ids_by_time(posts, table, max_count)
        table = table.join(first.select("id"), "id", "left_semi")
    dated = table.join(posts.select("id", "created_at"), "id").withColumn("month", month_of(F.col("created_at")))
    months = posts.join(table.select("id"), "id", "left_semi").select(month_of(F.col("created_at")).alias("month"))
    numbered = months.distinct().withColumn("slice", F.row_number().over(W.orderBy("month")) - 1)
    return dated.join(F.broadcast(numbered), "month")


def write_by_time(dated: DataFrame, path: str) -> None:
    """One folder per month, rows in time order; a busy month is spread over several files."""
    dated.repartitionByRange("created_at", "id").sortWithinPartitions("month", "created_at", "id").write.mode(
        "overwrite"
    ).partitionBy("month").parquet(path)


def topic_shares(doc_topics: DataFrame, topic_ids: int | list[int], min_threshold: float = HISTOGRAM_MIN_PROB) -> DataFrame:
    """``(id, topic_id, prob)`` of shares above the threshold."""
    chosen = [topic_ids] if isinstance(topic_ids, int) else list(topic_ids)
    return doc_topics.where(F.col("topic_id").isin(chosen) & (F.col("prob") > min_threshold)).select(
        "id", "topic_id", "prob"
    )


def share_histogram(
    doc_topics: DataFrame, topic_ids: int | list[int], min_threshold: float = HISTOGRAM_MIN_PROB
) -> DataFrame:
    """``(topic_id, bin, bin_start, n)``: articles per tenth of the share, empty bins included."""
    chosen = [topic_ids] if isinstance(topic_ids, int) else list(topic_ids)
    position = F.least(F.floor(F.col("prob") * HISTOGRAM_BINS), F.lit(HISTOGRAM_BINS - 1)).cast("int")
    counted = (
        topic_shares(doc_topics, chosen, min_threshold)
        .groupBy("topic_id", position.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bins = doc_topics.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(t) for t in chosen])).alias("topic_id"),
        F.sequence(F.lit(0), F.lit(HISTOGRAM_BINS - 1)).alias("bins"),
    )
    grid = bins.select("topic_id", F.explode("bins").alias("bin"))
    return grid.join(counted, ["topic_id", "bin"], "left").select(
        "topic_id",
        "bin",
        (F.col("bin") / F.lit(HISTOGRAM_BINS)).alias("bin_start"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


"""Filters, lookups and joins over articles and their post metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.text import first_bytes

MIN_POINTS = 50
POST_FIELDS = ("title", "url", "num_points", "author", "created_at")


def required(broken: Column, *message: Column | str) -> Column:
    """A condition that holds for all rows, or ends the query at the first row where ``broken`` holds."""
    parts = [part if isinstance(part, Column) else F.lit(part) for part in message]
    return F.when(broken, F.raise_error(F.concat(*parts)).cast("boolean")).otherwise(F.lit(True))


def with_metadata(texts: DataFrame, posts: DataFrame) -> DataFrame:
    """Every text with the fields of its post; a text must have exactly one, else the query fails.

    Posts are counted per id on the way into the join, so the check reads nothing again. See
    ``metadata_problems`` for a list of what is wrong.
    """
    fields = F.struct(*[F.col(name) for name in POST_FIELDS])
    single = posts.groupBy("id").agg(F.count(F.lit(1)).alias("_posts"), F.first(fields).alias("_post"))
    joined = texts.join(single, "id", "left")
    name = F.coalesce(F.col("id").cast("string"), F.lit("without id"))
    checked = joined.where(required(F.coalesce("_posts", F.lit(0)) != 1, "article ", name, " has ", F.coalesce("_posts", F.lit(0)).cast("string"), " posts"))
    return checked.select(*texts.columns, *[F.col("_post").getField(name).alias(name) for name in POST_FIELDS])


def metadata_problems(texts: DataFrame, posts: DataFrame) -> DataFrame:
    """``(problem, ids)``: texts without a post and posts that share an id. Empty is good."""
    missing = texts.select("id").join(posts.select("id"), "id", "left_anti").select(F.lit("no post").alias("problem"))
    repeated = (
        posts.groupBy("id").count().where("count > 1").select(F.lit("repeated post").alias("problem"))
    )
    return missing.union(repeated).groupBy("problem").agg(F.count(F.lit(1)).alias("ids"))


def valid_articles(articles: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """Articles with at least ``min_points``; without metadata, all of them."""
    if "num_points" not in articles.columns:
        return articles
    return articles.where(F.col("num_points") >= min_points)


def first_articles(articles: DataFrame, max_count: int | None = None) -> DataFrame:
    """The first articles by id, counted before any other filter. Ids must be unique.

    Only ids are sorted; the texts are filtered by the last of them where they are.
    """
    if max_count is None:
        return articles
    last = articles.select("id").orderBy("id").limit(max_count).agg(F.max("id")).scalar()
    return articles.where(F.col("id") <= last)


def stream_articles(
    texts: DataFrame,
    posts: DataFrame | None = None,
    max_count: int | None = None,
    min_points: int = MIN_POINTS,
) -> DataFrame:
    chosen = first_articles(texts, max_count)
    return chosen if posts is None else valid_articles(with_metadata(chosen, posts), min_points)


def posts_with_text(posts: DataFrame, texts: DataFrame) -> DataFrame:
    return posts.join(texts.select("id"), "id", "left_semi")


def posts_by_ids(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """Posts for ``(id, pos)`` in the order of ``pos``; an id may be asked for twice."""
    return ids.select("id", "pos").join(posts, "id").orderBy("pos", "id")


def ids_without_post(ids: DataFrame, posts: DataFrame) -> DataFrame:
    return ids.join(posts.select("id"), "id", "left_anti")


def posts_in(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """Posts whose id is in ``ids``, each once."""
    return posts.join(ids.select("id"), "id", "left_semi")


def rows_of(table: DataFrame, ids: int | list[int] | DataFrame) -> DataFrame:
    """Rows of one id, a list of ids or a table of ids, from a table clustered by id.

    Literal ids reach the Parquet scan, where row-group statistics skip the rest.
    """
    if isinstance(ids, DataFrame):
        return table.join(ids.select("id"), "id", "left_semi")
    wanted = [ids] if isinstance(ids, int) else list(ids)
    return table.where(F.col("id").isin(wanted))


def article_texts(texts: DataFrame, max_length: int | None = None) -> DataFrame:
    """Whole texts, or the first ``max_length`` bytes of each."""
    return texts.select("id", first_bytes(F.col("text"), max_length).alias("text"))


def long_enough(articles: DataFrame, min_article_length: int | None = None) -> DataFrame:
    if min_article_length is None:
        return articles
    return articles.where(F.char_length("text") >= min_article_length)


def not_done(work: DataFrame, done: DataFrame) -> DataFrame:
    return work.join(done.select("id"), "id", "left_anti")


def top_rows(rows: DataFrame, order: list[Column], top_n: int | None) -> DataFrame:
    ordered = rows.orderBy(*order)
    return ordered if top_n is None else ordered.limit(top_n)


def top_rows_per(rows: DataFrame, key: str, order: list[Column], top_n: int, rank: str = "rank") -> DataFrame:
    """The first ``top_n`` rows of each key; Spark limits each group before the shuffle too."""
    ranked = rows.withColumn(rank, F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col(rank) <= top_n)

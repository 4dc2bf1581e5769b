"""Filters, lookups and joins over articles and posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import articles as A
from newsloom.workload.oracle import sql
from newsloom.workload.registry import query
from newsloom.workload.source_queries import POST_COLUMNS_SQL, TIMESTAMP_TEXT, post_columns


@query(
    "b1_articles_with_metadata",
    sql(
        """SELECT p.id, title, url, num_points, author, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
            length(text) AS n_chars, md5(text) AS digest FROM posts p JOIN texts t ON t.id = p.id""",
        "posts",
        "texts",
    ),
)
def articles_with_metadata(t):
    return A.with_metadata(t.texts, t.posts).select(
        "id",
        "title",
        "url",
        "num_points",
        "author",
        F.date_format("created_at", TIMESTAMP_TEXT).alias("created_at"),
        F.length("text").cast("long").alias("n_chars"),
        F.md5("text").alias("digest"),
    )


@query(
    "b1_metadata_problems",
    """SELECT 'no post' AS problem, count(*) AS ids FROM documents
        WHERE doc_id NOT IN (SELECT page_id FROM pages) HAVING count(*) > 0
    UNION ALL SELECT 'repeated post', count(*) FROM (
        SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 1) HAVING count(*) > 0""",
)
def metadata_problems(t):
    """Pages have only some of the ids, conversations have ids that repeat."""
    missing = A.metadata_problems(t.texts, t.read("pages").select(F.col("page_id").alias("id")))
    turns = t.read("conversations").select(F.col("conv_id").alias("id"))
    return missing.union(A.metadata_problems(turns, turns))


@query("b2_valid_articles", sql("SELECT id, num_points FROM posts WHERE num_points >= 50", "posts"))
def valid_articles(t):
    return A.stream_articles(t.texts, t.posts).select("id", "num_points")


@query(
    "b3_first_articles",
    sql(
        """SELECT id, num_points FROM posts WHERE num_points >= 50
        AND id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100)""",
        "posts",
    ),
)
def first_articles(t):
    return A.stream_articles(t.texts, t.posts, max_count=100).select("id", "num_points")


@query(
    "b4_posts_with_text",
    """SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS created_date FROM orders
    WHERE o_orderkey IN (SELECT doc_id FROM documents)""",
)
def posts_with_text(t):
    return A.posts_with_text(t.dates, t.texts).select("id", F.col("created_date").cast("string").alias("created_date"))


@query(
    "b5_posts_by_ids",
    sql(POST_COLUMNS_SQL.replace("SELECT id,", "SELECT -id AS pos, id,") + " FROM posts WHERE id IN (SELECT doc_id FROM labels)", "posts"),
)
def posts_by_ids(t):
    wanted = t.label_ids.withColumn("pos", -F.col("id"))
    found = A.posts_by_ids(t.posts, wanted)
    return post_columns(found).join(wanted, "id")


@query(
    "b5_ids_without_post",
    "SELECT page_id AS id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)",
)
def ids_without_post(t):
    return A.ids_without_post(t.read("pages").select(F.col("page_id").alias("id")), t.label_ids)


@query("b8_long_enough", "SELECT doc_id AS id, length(text) AS n_chars FROM documents WHERE length(text) >= 1000")
def long_enough(t):
    return A.long_enough(t.texts, 1000).select("id", F.length("text").cast("long").alias("n_chars"))


@query("b9_not_done", "SELECT page_id AS id, url FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def not_done(t):
    return A.not_done(t.read("pages").select(F.col("page_id").alias("id"), "url"), t.label_ids)


@query("b10_posts_in", sql(POST_COLUMNS_SQL + " FROM posts WHERE id IN (SELECT doc_id FROM labels)", "posts"))
def posts_in(t):
    return post_columns(A.posts_in(t.posts, t.label_ids))

"""Topics over time, on rule topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions.staging import scratch_path
from newsloom.operators import topic_model as E
from newsloom.operators import trends as T
from newsloom.operators.features import flat_bags_of_words, tokenise
from newsloom.plans.corpus import ArticleCorpus
from newsloom.workload.oracle import sql
from newsloom.workload.registry import query
from newsloom.workload.source_queries import TIMESTAMP_TEXT, token_digests
from newsloom.workload.tables import NUM_TOPICS


def trends_sql(window: int) -> str:
    frame = f"ROWS BETWEEN {window // 2} PRECEDING AND {(window - 1) // 2} FOLLOWING"
    return f"""SELECT topic_id, strftime(created_date, '%Y-%m-%d') AS created_date, round(value, 6) AS value,
        CASE WHEN count(*) OVER w = {window} THEN round(avg(value) OVER w, 6) END AS rolling
    FROM (SELECT topic_id, created_date, sum(prob) AS value FROM doc_topics d JOIN posts p ON p.id = d.id
          WHERE prob > 0.1 GROUP BY topic_id, created_date)
    WINDOW w AS (PARTITION BY topic_id ORDER BY created_date {frame})"""


def shown(trends):
    return trends.select(
        "topic_id",
        F.col("created_date").cast("string").alias("created_date"),
        F.round("value", 6).alias("value"),
        F.round("rolling", 6).alias("rolling"),
    )


@query("t1_dates", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS created_date FROM orders")
def dates(t):
    return t.dates.select("id", T.date_of(F.col("created_at")).cast("string").alias("created_date"))


@query("t2_months", "SELECT o_orderkey AS id, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month FROM orders")
def months(t):
    return t.dates.select("id", T.month_of(F.col("created_at")).cast("string").alias("month"))


@query("t3_topic_trends", sql(trends_sql(30), "doc_topics", "posts"))
def topic_trends(t):
    return shown(T.topic_trends(t.vectors, t.dates))


@query("t3_topic_trends_odd_window", sql(trends_sql(5), "doc_topics", "posts"))
def topic_trends_odd_window(t):
    return shown(T.topic_trends(t.vectors, t.dates, window_size=5))


@query("t3_one_topic_trend", sql(f"SELECT * FROM ({trends_sql(30)}) WHERE topic_id = 3", "doc_topics", "posts"))
def one_topic_trend(t):
    """Read from the layout by topic and share: only the shares of this topic above the bound."""
    path = scratch_path(t.spark, "topics")
    E.write_topics(t.vectors, path)
    by_article, by_topic = (t.spark.read.parquet(f"{path}/{name}") for name in ("by_article", "by_topic"))
    return shown(T.topic_trends(by_article, t.dates, 3, doc_topics=by_topic))


@query(
    "t4_trend_series",
    sql(
        f"""SELECT topic_id, 'Topic #' || topic_id AS name, label, created_date AS x, rolling AS y
        FROM ({trends_sql(30)}) JOIN labels10 USING (topic_id)""",
        "doc_topics",
        "posts",
        "labels10",
    ),
)
def trend_series(t):
    series = T.topic_trend_series(T.topic_trends(t.vectors, t.dates), E.top_words(t.topic_words))
    return series.withColumn("x", F.col("x").cast("string")).withColumn("y", F.round("y", 6))


@query(
    "t5_article_counts",
    sql(
        """SELECT strftime(created_date, '%Y-%m-%d') AS created_date, n,
            CASE WHEN count(*) OVER w = 5 THEN round(avg(n) OVER w, 6) END AS rolling
        FROM (SELECT created_date, count(*) AS n FROM posts WHERE id IN (SELECT doc_id FROM labels) GROUP BY created_date)
        WINDOW w AS (ORDER BY created_date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
        "posts",
    ),
)
def article_counts(t):
    counts = T.article_counts(t.dates, t.label_ids)
    return counts.select(
        F.col("created_date").cast("string").alias("created_date"), "n", F.round("rolling", 6).alias("rolling")
    )


@query(
    "t6_time_slices",
    sql(
        """SELECT strftime(date_trunc('month', created_at), '%Y-%m-%d') AS month, count(*) AS n
        FROM posts GROUP BY 1""",
        "posts",
    ),
)
def time_slices(t):
    return T.time_slices(t.dates, t.texts).withColumn("month", F.col("month").cast("string"))


@query(
    "t7_ids_by_time",
    sql("SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM posts", "posts"),
)
def ids_by_time(t):
    return T.ids_by_time(t.dates, t.texts).withColumn("created_at", F.date_format("created_at", TIMESTAMP_TEXT))


@query(
    "t7_first_ids_by_time",
    sql(
        """SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM posts
        ORDER BY posts.created_at, id LIMIT 50""",
        "posts",
    ),
)
def first_ids_by_time(t):
    first = T.ids_by_time(t.dates, t.texts, 50)
    return first.withColumn("created_at", F.date_format("created_at", TIMESTAMP_TEXT))


SLICES_SQL = """SELECT id, CAST(dense_rank() OVER (ORDER BY date_trunc('month', created_at)) - 1 AS INTEGER) AS slice
    FROM posts"""


@query(
    "t8_tokens_by_time",
    sql(
        f"""SELECT id, slice, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest
        FROM tokens JOIN ({SLICES_SQL}) USING (id)""",
        "tokens",
        "posts",
    ),
)
def tokens_by_time(t):
    path = scratch_path(t.spark, "tokens_by_time")
    T.write_by_time(T.by_time(tokenise(t.texts), t.dates), path)
    stored = t.spark.read.parquet(path)
    return token_digests(stored).join(stored.select("id", "slice"), "id")


@query(
    "t8_bags_by_time",
    sql(
        f"""SELECT id, slice, term, count(*) AS n
        FROM words JOIN vocabulary USING (term) JOIN ({SLICES_SQL}) USING (id) GROUP BY ALL""",
        "words",
        "vocabulary",
        "posts",
    ),
)
def bags_by_time(t):
    corpus = ArticleCorpus(t.texts, t.dates, tokens_path=scratch_path(t.spark, "tokens"))
    flat = flat_bags_of_words(corpus.bags_by_time())
    return flat.join(corpus.vocabulary(), "term_id").select("id", "slice", "term", "n")


@query("t9_topic_shares", sql("SELECT id, topic_id, prob FROM doc_topics WHERE prob > 0.05", "doc_topics"))
def topic_shares(t):
    return T.topic_shares(t.doc_topics, list(range(NUM_TOPICS)))


@query(
    "t10_share_histogram",
    sql(
        """SELECT g.topic_id, g.bin, g.bin / 10 AS bin_start, coalesce(c.n, 0) AS n
        FROM (SELECT topic_id, CAST(range AS INTEGER) AS bin FROM topics, range(10)) g
        LEFT JOIN (SELECT topic_id, CAST(least(floor(prob * 10), 9) AS INTEGER) AS bin, count(*) AS n
                   FROM doc_topics WHERE prob > 0.05 GROUP BY ALL) c ON c.topic_id = g.topic_id AND c.bin = g.bin""",
        "topics",
        "doc_topics",
    ),
)
def share_histogram(t):
    return T.share_histogram(t.doc_topics, list(range(NUM_TOPICS)))

"""Articles of topics, topics of articles and interesting topics, on rule topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions.staging import scratch_path
from newsloom.operators import ranking as R
from newsloom.operators import topic_model as E
from newsloom.workload.oracle import sql
from newsloom.workload.registry import query
from newsloom.workload.tables import NUM_TOPICS

SNIPPET_SQL = """SELECT id, left(text, k) AS snippet FROM (
    SELECT t.id, t.text, max(CAST(r.range AS INTEGER)) AS k
    FROM texts t JOIN hits USING (id) JOIN range(501) r ON strlen(left(t.text, CAST(r.range AS INTEGER))) <= 500
    GROUP BY t.id, t.text)"""


@query("e5_rule_topic_shares", sql("SELECT id, topic_id, prob FROM doc_topics", "doc_topics"))
def rule_topic_shares(t):
    return t.doc_topics


@query("e8_top_words", sql("SELECT topic_id, label FROM labels10", "labels10"))
def top_words(t):
    return E.top_words(t.topic_words).select("topic_id", "label")


@query(
    "e4_normalised_topic_words",
    sql(
        """SELECT topic_id, term, round(weight / sum(weight) OVER (PARTITION BY topic_id), 9) AS weight
        FROM topic_words""",
        "topic_words",
    ),
)
def normalised_topic_words(t):
    return E.normalise_topic_words(t.topic_words).select("topic_id", "term", F.round("weight", 9).alias("weight"))


@query("f1_topic_articles", sql("SELECT id, prob FROM doc_topics WHERE topic_id = 3 AND prob > 0.1", "doc_topics"))
def topic_articles(t):
    return R.topic_articles(t.doc_topics, 3)


@query(
    "f1_top_topic_articles",
    sql(
        "SELECT id, prob FROM doc_topics WHERE topic_id = 3 AND prob > 0.1 ORDER BY prob DESC, id LIMIT 20",
        "doc_topics",
    ),
)
def top_topic_articles(t):
    return R.topic_articles(t.doc_topics, 3, top_n=20)


@query(
    "f1_topic_articles_without",
    sql(
        """SELECT id, prob FROM doc_topics WHERE topic_id = 3 AND prob > 0.1
        AND id NOT IN (SELECT id FROM doc_topics WHERE topic_id IN (4, 5) AND prob > 0.1)""",
        "doc_topics",
    ),
)
def topic_articles_without(t):
    return R.topic_articles(t.doc_topics, 3, negative_ids=[4, 5])


@query(
    "f2_topic_intersection",
    sql(
        """SELECT id, round(sum(prob) / 2, 9) AS prob FROM doc_topics WHERE topic_id IN (1, 3)
        GROUP BY id HAVING sum(prob) / 2 > 0.1""",
        "doc_topics",
    ),
)
def topic_intersection(t):
    return R.topic_articles(t.doc_topics, [1, 3]).withColumn("prob", F.round("prob", 9))


@query(
    "f2_best_of_topics",
    sql(
        """SELECT id, round(sum(prob) / 2, 9) AS prob FROM doc_topics WHERE topic_id IN (1, 3)
        GROUP BY id HAVING sum(prob) / 2 > 0.1 ORDER BY sum(prob) / 2 DESC, id LIMIT 20""",
        "doc_topics",
    ),
)
def best_of_topics(t):
    """The same from the stored layouts, read from the highest shares downwards."""
    path = scratch_path(t.spark, "topics")
    E.write_topics(t.vectors, path)
    by_topic, by_article = (t.spark.read.parquet(f"{path}/{name}") for name in ("by_topic", "by_article"))
    return R.best_articles_of_topics(by_topic, by_article, [1, 3], 20).withColumn("prob", F.round("prob", 9))


@query(
    "f3_article_topics",
    sql(
        """SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY prob DESC, topic_id) AS INTEGER) AS rank,
            topic_id, prob FROM doc_topics WHERE prob > 0.1""",
        "doc_topics",
    ),
)
def article_topics(t):
    return E.article_topics(t.vectors)


@query("f4_topic_scores", sql("SELECT topic_id, round(score, 9) AS score FROM scores", "scores"))
def topic_scores(t):
    return R.topic_scores(t.doc_topics, NUM_TOPICS).withColumn("score", F.round("score", 9))


@query(
    "f5_topics_table",
    sql("SELECT rank, topic_id, round(score, 9) AS score, label FROM topic_table", "topic_table"),
)
def topics_table(t):
    table = R.topics_table(R.topic_scores(t.doc_topics, NUM_TOPICS), E.top_words(t.topic_words))
    return table.select("rank", "topic_id", F.round("score", 9).alias("score"), "label")


@query(
    "f6_show_topic_articles",
    sql(
        f""", hits AS (SELECT id, prob FROM doc_topics WHERE topic_id = 3 AND prob > 0.1),
        snippets AS ({SNIPPET_SQL})
        SELECT h.id, h.prob, p.url, p.title, s.snippet
        FROM hits h JOIN posts p ON p.id = h.id JOIN snippets s ON s.id = h.id""",
        "posts",
        "texts",
        "doc_topics",
    ),
)
def show_topic_articles(t):
    return R.show_topic_articles(t.doc_topics, t.posts, t.texts, 3)


@query(
    "f6_show_top_topic_articles",
    sql(
        f""", hits AS (SELECT id, sum(prob) / 2 AS prob FROM doc_topics WHERE topic_id IN (1, 3)
            GROUP BY id HAVING sum(prob) / 2 > 0.1 ORDER BY prob DESC, id LIMIT 5),
        snippets AS ({SNIPPET_SQL})
        SELECT h.id, round(h.prob, 9) AS prob, p.url, p.title, s.snippet
        FROM hits h JOIN posts p ON p.id = h.id JOIN snippets s ON s.id = h.id""",
        "posts",
        "texts",
        "doc_topics",
    ),
)
def show_top_topic_articles(t):
    shown = R.show_topic_articles(t.doc_topics, t.posts, t.texts, [1, 3], top_n=5)
    return shown.withColumn("prob", F.round("prob", 9))


@query(
    "f7_show_article_topics",
    sql(
        f""", hits AS (SELECT doc_id AS id FROM labels), snippets AS ({SNIPPET_SQL}),
        ranked AS (SELECT id, topic_id, prob,
            CAST(row_number() OVER (PARTITION BY id ORDER BY prob DESC, topic_id) AS INTEGER) AS rank
            FROM doc_topics WHERE prob > 0.1 AND id IN (SELECT id FROM hits))
        SELECT r.id, r.rank, r.topic_id, r.prob, l.label, p.url, p.title, s.snippet
        FROM ranked r JOIN labels10 l ON l.topic_id = r.topic_id JOIN posts p ON p.id = r.id
             JOIN snippets s ON s.id = r.id""",
        "posts",
        "texts",
        "doc_topics",
        "labels10",
    ),
)
def show_article_topics(t):
    shown = R.show_article_topics(t.vectors, t.posts, t.texts, E.top_words(t.topic_words), t.label_ids)
    return shown.select("id", "rank", "topic_id", "prob", "label", "url", "title", "snippet")

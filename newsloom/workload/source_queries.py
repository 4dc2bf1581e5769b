"""Reading and writing articles, work lists, manifests and model files."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions.staging import scratch_path
from newsloom.operators.articles import article_texts, rows_of
from newsloom.operators.features import tokenise
from newsloom.operators.topic_model import top_words
from newsloom.plans.ingest import ingest_pages, stored_articles
from newsloom.sources import (
    append_ids,
    article_metrics,
    extract_articles,
    materialise_tokens,
    read_corpus_file,
    read_doc_topics_file,
    read_manifest,
    read_posts,
    read_text_folder,
    read_topic_keys_file,
    read_work_list,
    rejected_pages,
    write_articles,
    write_text_folder,
)
from newsloom.workload.oracle import sql
from newsloom.workload.registry import query

TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss"


def digests(texts):
    """Whole texts, compared by length and digest."""
    return texts.select("id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def token_digests(tokens):
    return tokens.select(
        "id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.md5(F.array_join("tokens", " ")).alias("digest"),
    )


def post_columns(posts):
    return posts.select(
        "id",
        "title",
        "url",
        "num_points",
        "author",
        F.date_format("created_at", TIMESTAMP_TEXT).alias("created_at"),
        F.col("created_date").cast("string").alias("created_date"),
    )


POST_COLUMNS_SQL = """SELECT id, title, url, num_points, author,
    strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(created_date, '%Y-%m-%d') AS created_date"""
DIGESTS_SQL = "SELECT id, length(text) AS n_chars, md5(text) AS digest"
TOKEN_DIGESTS_SQL = "SELECT id, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest"


@query("a1_read_posts_csv", sql(POST_COLUMNS_SQL + " FROM posts", "posts"))
def read_posts_csv(t):
    path = scratch_path(t.spark, "posts.csv")
    as_text = t.posts.withColumn("created_at", F.date_format("created_at", "M/d/yyyy H:mm")).drop("created_date")
    # Spark's writer trims blanks unless told not to.
    as_text.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return post_columns(read_posts(t.spark, path, "csv", "M/d/yyyy H:mm"))


@query("a1_read_posts_parquet", sql(POST_COLUMNS_SQL + " FROM posts", "posts"))
def read_posts_parquet(t):
    path = scratch_path(t.spark, "posts")
    t.posts.drop("created_date").write.parquet(path)
    return post_columns(read_posts(t.spark, path))


@query("a2_text_folder", sql(DIGESTS_SQL + " FROM texts", "texts"))
def text_folder(t):
    path = scratch_path(t.spark, "texts")
    write_text_folder(t.texts, path)
    found = read_text_folder(t.spark, path, r"/id=([0-9]+)\.txt$")
    # The writer ends every file with a line feed that the text does not have.
    return digests(found.withColumn("text", F.regexp_replace("text", r"\n\z", "")))


@query("a3_work_list", "SELECT page_id AS id, url FROM pages")
def work_list(t):
    path = scratch_path(t.spark, "work")
    lines = F.concat_ws(" ", F.col("page_id").cast("string"), "url")
    t.read("pages").select(lines.alias("value")).write.text(path)
    return read_work_list(t.spark, path)


@query("a4_manifest", "SELECT doc_id AS id FROM labels")
def manifest(t):
    path = scratch_path(t.spark, "done")
    t.label_ids.write.csv(path)
    absent = read_manifest(t.spark, scratch_path(t.spark, "absent"))
    return read_manifest(t.spark, path).union(absent)


def _element(name: str, column: str) -> str:
    return rf"regexp_replace({column}, '(?is)<{name}\b[^>]*>.*?(?:</{name}\s*>|\z)', '', 'g')"


def _pages_sql() -> str:
    """The page rules, one element after the other, as RE2 has no back references."""
    clean = r"regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', '', 'g')"
    for name in ("script", "style", "nav", "footer"):
        clean = _element(name, clean)
    clean = rf"""regexp_replace({clean}, '(?is)<div\b[^>]*\bclass="ad"[^>]*>.*?(?:</div\s*>|\z)', '', 'g')"""
    article = rf"regexp_extract({clean}, '(?is)<article\b[^>]*>(.*?)(?:</article\s*>|\z)', 1)"
    article = rf"regexp_replace({article}, '(?is)<h1\b[^>]*>.*?</h1\s*>', '', 'g')"
    text = rf"regexp_replace({article}, '[\r\n\t ]+', ' ', 'g')"
    text = rf"regexp_replace({text}, '(?i)</?(?:p|br)\b[^>]*>', chr(10), 'g')"
    text = rf"regexp_replace({text}, '<[/!?a-zA-Z][^>]*>', '', 'g')"
    text = rf"replace(replace(replace({text}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>')"
    text = f"replace(replace(replace({text}, '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
    text = rf"regexp_replace({text}, ' {{2,}}', ' ', 'g')"
    text = rf"regexp_replace({text}, ' *\n[ \n]*', chr(10) || chr(10), 'g')"
    text = rf"regexp_replace({text}, '^[ \n]+|[ \n]+$', '', 'g')"
    title = r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)"
    title = f"replace(replace({title}, '&quot;', '\"'), '&amp;', '&')"
    title = rf"trim(regexp_replace({title}, '\s+', ' ', 'g'))"
    return f"SELECT page_id AS id, url, {title} AS title, {text} AS text FROM pages".replace('\\"', '"')


PAGES_SQL = _pages_sql()
CUT_PAGES_SQL = PAGES_SQL.replace(
    "FROM pages",
    """FROM (SELECT page_id, url, CASE WHEN length(html) % 2 = 0 THEN split_part(html, '<body', 1) ELSE html END AS html
    FROM pages)""",
)


@query(
    "a5_extract_articles",
    f"SELECT id, url, title, length(text) AS n_chars, md5(text) AS digest FROM ({PAGES_SQL}) WHERE length(text) > 0",
)
def articles_of_pages(t):
    return extract_articles(t.pages).select(
        "id", "url", "title", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest")
    )


@query(
    "a5_rejected_pages",
    f"SELECT id, url, 'no article text' AS reason FROM ({CUT_PAGES_SQL}) WHERE length(text) = 0",
)
def pages_without_article(t):
    """Some pages break off before their body, as a failed download leaves them."""
    cut = F.when(F.length("html") % 2 == 0, F.substring_index("html", "<body", 1)).otherwise(F.col("html"))
    return rejected_pages(t.pages.withColumn("html", cut))


@query("a6_write_articles", sql(DIGESTS_SQL + " FROM texts", "texts"))
def stored_texts(t):
    path = scratch_path(t.spark, "articles")
    write_articles(t.texts, path)
    return digests(t.spark.read.parquet(path))


@query("a7_append_ids", "SELECT doc_id AS id FROM labels UNION ALL SELECT page_id FROM pages")
def appended_ids(t):
    path = scratch_path(t.spark, "done")
    append_ids(t.label_ids, path)
    append_ids(t.read("pages").select(F.col("page_id").alias("id")), path)
    return read_manifest(t.spark, path)


@query("a8_materialised_tokens", sql(TOKEN_DIGESTS_SQL + " FROM tokens", "tokens"))
def materialised_tokens(t):
    path = scratch_path(t.spark, "tokens")
    materialise_tokens(t.spark, path, t.texts, tokenise)

    def rebuilt(texts):
        raise AssertionError("the finished copy is read back")

    return token_digests(materialise_tokens(t.spark, path, t.texts, rebuilt))


@query(
    "a7_ingest_pages",
    f"""SELECT id, title, length(text) AS n_chars, md5(text) AS digest FROM ({PAGES_SQL})
    WHERE length(text) >= 1000 AND id NOT IN (SELECT doc_id FROM labels)""",
)
def ingested(t):
    """Work list minus manifest, extract, drop short articles, store, append to the manifest."""
    articles, done = scratch_path(t.spark, "articles"), scratch_path(t.spark, "done")
    append_ids(t.label_ids, f"{done}/run=labels")
    work = t.read("pages").select(F.col("page_id").alias("id"), "url")
    ingest_pages(work, t.pages, articles, done, min_article_length=1000)
    ingest_pages(work, t.pages, articles, done, min_article_length=1000)  # nothing is left to do
    stored = stored_articles(t.spark, articles, done)
    return stored.select("id", "title", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query(
    "a11_topic_keys_file",
    sql("SELECT topic_id, 0.05 AS alpha, replace(label, ', ', ' ') AS words FROM labels10", "labels10").replace(
        "0.05", "CAST(0.05 AS DOUBLE)"
    ),
)
def topic_keys_file(t):
    path = scratch_path(t.spark, "topic_keys")
    keys = top_words(t.topic_words).select(
        F.concat_ws("\t", F.col("topic_id").cast("string"), F.lit("0.05"), F.concat(F.array_join("words", " "), F.lit(" ")))
        .alias("value")
    )
    keys.write.text(path)
    return read_topic_keys_file(t.spark, path).withColumn("words", F.array_join("words", " "))


@query(
    "a11_doc_topics_file",
    sql("SELECT id, CAST(id AS VARCHAR) AS name, topic_id, round(prob, 9) AS prob FROM doc_topics", "doc_topics"),
)
def doc_topics_file(t):
    path = scratch_path(t.spark, "doc_topics")
    lines = t.vectors.select(
        F.concat_ws(
            "\t", F.col("id").cast("string"), F.col("id").cast("string"), F.array_join(F.col("shares").cast("array<string>"), "\t")
        ).alias("value")
    )
    header = t.spark.range(1).select(F.lit("#doc name topic proportion ...").alias("value"))
    header.union(lines).write.text(path)
    return (
        read_doc_topics_file(t.spark, path)
        .select("id", "name", F.posexplode("shares").alias("topic_id", "prob"))
        .where("prob > 0")
        .withColumn("prob", F.round("prob", 9))
    )


@query("a11_corpus_file", sql(TOKEN_DIGESTS_SQL + ", '0' AS label FROM tokens", "tokens"))
def corpus_file(t):
    path = scratch_path(t.spark, "corpus")
    tokens = tokenise(t.texts)
    tokens.select(
        F.concat_ws(" ", F.col("id").cast("string"), F.lit("0"), F.array_join("tokens", " ")).alias("value")
    ).write.text(path)
    found = read_corpus_file(t.spark, path)
    return token_digests(found).join(found.select("id", "label"), "id")


@query(
    "a12_progress_counts",
    "SELECT count(*) AS articles, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents",
)
def progress_counts(t):
    observed, observation = article_metrics(t.texts)
    write_articles(observed, scratch_path(t.spark, "articles"), clustered=False)
    return t.spark.createDataFrame([observation.get], "articles long, characters long")


@query("b6_tokens_of_articles", sql(TOKEN_DIGESTS_SQL + " FROM tokens WHERE id IN (SELECT doc_id FROM labels)", "tokens"))
def tokens_of_articles(t):
    """From stored tokens, clustered by id."""
    stored = materialise_tokens(t.spark, scratch_path(t.spark, "tokens"), t.texts, tokenise)
    return token_digests(rows_of(stored, t.label_ids))


@query(
    "b7_snippets",
    """SELECT id, left(text, k) AS snippet FROM (
        SELECT d.doc_id AS id, d.text, max(CAST(r.range AS INTEGER)) AS k
        FROM documents d JOIN range(501) r ON strlen(left(d.text, CAST(r.range AS INTEGER))) <= 500
        GROUP BY d.doc_id, d.text)""",
)
def snippets(t):
    return article_texts(t.texts, 500).select("id", F.col("text").alias("snippet"))


@query("b7_whole_texts", sql(DIGESTS_SQL + " FROM texts", "texts"))
def whole_texts(t):
    return digests(article_texts(t.texts))

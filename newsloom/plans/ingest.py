"""From raw pages to stored article texts.

As a job: ``spark-submit --py-files newsloom.zip newsloom/plans/ingest.py --work ids.txt
--pages pages --articles articles --manifest done --min-article-length 500``.
"""

from __future__ import annotations

import argparse
import hashlib
import time
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions.staging import path_exists
from newsloom.operators.articles import long_enough, not_done
from newsloom.sources.articles import read_manifest, read_work_list
from newsloom.sources.pages import extract_articles
from newsloom.sources.progress import article_metrics, rates

ARTICLE_SCHEMA = "id long, title string, text string"


def ingest_pages(
    work: DataFrame,
    pages: DataFrame,
    articles_path: str,
    manifest_path: str,
    min_article_length: int | None = None,
) -> dict[str, float]:
    """Extract and store the articles of ``(id, url)`` that the manifest does not list yet.

    Each run writes its own folder under ``articles_path`` and then adds the ids read back
    from it to the manifest, under the same run. An article counts as stored once its run is
    in the manifest, so a run that died halfway leaves nothing to clean up. Returns counts
    and rates. Read the result with ``stored_articles``.
    """
    started = time.monotonic()
    counts = _store(work, pages, articles_path, manifest_path, min_article_length, f"run={uuid.uuid4().hex}")
    return counts | rates(counts, time.monotonic() - started)


def _store(work: DataFrame, pages: DataFrame, articles_path: str, manifest_path: str, min_article_length: int | None, run: str) -> dict[str, int]:
    """Write the articles of one run and then its ids; a run that is repeated replaces itself."""
    spark = pages.sparkSession
    todo = not_done(work, read_manifest(spark, manifest_path, without=run))
    fetched = pages.join(todo.select(F.col("id").alias("page_id")), "page_id", "left_semi")
    articles = long_enough(extract_articles(fetched), min_article_length)
    observed, observation = article_metrics(articles.select("id", "title", "text"), f"ingest-{uuid.uuid4().hex}")
    observed.write.mode("overwrite").parquet(f"{articles_path}/{run}")
    spark.read.schema(ARTICLE_SCHEMA).parquet(f"{articles_path}/{run}").select("id").write.mode("overwrite").csv(f"{manifest_path}/{run}")
    return observation.get


def ingest_stream(
    work: DataFrame,
    pages: DataFrame,
    articles_path: str,
    manifest_path: str,
    checkpoint: str,
    min_article_length: int | None = None,
    report: Callable[[dict[str, float]], None] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """The same as pages arrive: every micro-batch of the stream ``pages`` is a run.

    A batch that broke off is repeated by the checkpoint under the same name and replaces what it had
    written, so each article is stored and listed once. After each batch ``report`` gets its number, the
    counts and rates of the batch, and ``total_`` counts and rates since the query started. Pages of
    several files in a batch must differ in id.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    started = time.monotonic()
    totals: Counter = Counter()

    def commit(batch: DataFrame, number: int) -> None:
        began = time.monotonic()
        counts = _store(work, batch, articles_path, manifest_path, min_article_length, f"run=stream-{name}-{number}")
        totals.update(counts)
        if report is not None:
            now = time.monotonic()
            total = {f"total_{key}": value for key, value in (dict(totals) | rates(totals, now - started)).items()}
            report({"batch": number, **counts, **rates(counts, now - began), **total})

    writer = pages.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stored_articles(spark: SparkSession, articles_path: str, manifest_path: str) -> DataFrame:
    """``(id, title, text)`` of all articles whose run has finished."""
    if not path_exists(spark, manifest_path):
        return spark.createDataFrame([], ARTICLE_SCHEMA)
    stored = spark.read.schema(f"{ARTICLE_SCHEMA}, run string").parquet(articles_path)
    finished = spark.read.schema("id long, run string").csv(manifest_path)
    return stored.join(finished, ["id", "run"], "left_semi").drop("run")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Extract and store the articles of a work list.")
    parser.add_argument("--work", required=True, help="text lines of id and url")
    parser.add_argument("--pages", required=True, help="Parquet of page_id, url, html")
    parser.add_argument("--articles", required=True, help="where article texts are stored")
    parser.add_argument("--manifest", required=True, help="where the ids of stored articles are listed")
    parser.add_argument("--min-article-length", type=int, help="shorter articles are left out; default none")
    options = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("ingest").getOrCreate()
    counts = ingest_pages(
        read_work_list(spark, options.work),
        spark.read.parquet(options.pages),
        options.articles,
        options.manifest,
        options.min_article_length,
    )
    print(", ".join(f"{name} {value:.6g}" for name, value in counts.items()))


if __name__ == "__main__":
    main()

"""What the physical plans must look like for large inputs."""

import pytest
from pyspark.sql import functions as F

from newsloom.operators import articles as A
from newsloom.operators import features as C
from newsloom.operators import ranking as R
from newsloom.operators import search_index as D
from newsloom.operators import topic_model as E
from newsloom.operators import trends as T


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Tables as they are stored, larger than the broadcast threshold is set to below."""
    root = tmp_path_factory.mktemp("stored")
    ids = spark.range(0, 2000, 1, 4)
    tables = {
        "texts": ids.select("id", F.expr("concat('The word', id % 7, ' and the other')").alias("text")),
        "vectors": ids.select("id", F.expr("array(id % 10 / 10.0D, 1 - id % 10 / 10.0D)").alias("shares")),
        "posts": ids.select("id", F.expr("date_add(date'2016-01-01', cast(id % 90 as int))").alias("created_date")),
    }
    for name, table in tables.items():
        table.write.parquet(str(root / name))
    read = {name: spark.read.parquet(str(root / name)) for name in tables}
    E.write_topics(read["vectors"], str(root / "topics"))
    D.write_index(D.index_documents(read["texts"]), str(root / "index"))
    read["by_topic"] = spark.read.parquet(str(root / "topics" / "by_topic"))
    read["index"] = spark.read.parquet(str(root / "index"))
    return read


def test_topic_filter_reaches_the_scan(stored):
    plan = plan_of(R.topic_articles(stored["by_topic"], 1, top_n=5))
    assert "EqualTo(topic_id,1)" in plan and "GreaterThan(prob,0.1)" in plan
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_lookups_reach_the_scan(stored):
    assert "EqualTo(token,word3)" in plan_of(D.query_index(stored["index"], "word3"))
    assert "EqualTo(id,3)" in plan_of(A.rows_of(stored["texts"], 3))
    assert "In(id, [3,5,8])" in plan_of(A.rows_of(stored["texts"], [3, 5, 8]))
    # The stored column is called id.
    points = stored["posts"].withColumnRenamed("id", "num_points")
    assert "GreaterThanOrEqual(id,50)" in plan_of(A.valid_articles(points))


def test_only_needed_columns_are_read(stored):
    plan = plan_of(A.posts_with_text(stored["posts"], stored["texts"]))
    assert "ReadSchema: struct<id:bigint>" in plan


def test_work_inside_the_row_needs_no_shuffle(stored):
    tokens = C.tokenise(stored["texts"])
    for frame in (
        tokens,
        D.index_documents(stored["texts"], preprocess_tokens=True),
        E.long_topics(stored["vectors"]),
        E.article_topics(stored["vectors"]),
        A.article_texts(stored["texts"], 500),
    ):
        assert "Exchange" not in plan_of(frame)


def test_term_counts_shuffle_once_after_summing(stored):
    plan = plan_of(C.term_counts(C.tokenise(stored["texts"])))
    assert plan.count("Exchange") == 1 and "partial_count" in plan
    assert plan.count("regexp_extract_all") == 1


def test_first_articles_sort_ids_only(stored):
    plan = plan_of(A.first_articles(stored["texts"], 10))
    above = plan.split("Subquery")[0]
    assert "Sort" not in above and "Exchange" not in above
    assert "ReadSchema: struct<id:bigint>" in plan


def test_trend_joins_one_row_per_article(spark, stored):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(T.topic_trends(stored["vectors"], stored["posts"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The shares are taken apart above the join, and summed before the next shuffle.
    assert plan.index("Generate") < plan.index("SortMergeJoin")
    assert "partial_sum" in plan


def test_trends_of_given_topics_filter_the_scan(stored):
    plan = plan_of(T.topic_trends(stored["vectors"], stored["posts"], [1], doc_topics=stored["by_topic"]))
    assert "EqualTo(topic_id,1)" in plan and "GreaterThan(prob,0.1)" in plan
    few = T.topic_trends(stored["vectors"], stored["posts"], [1], doc_topics=stored["by_topic"])
    all_ways = T.topic_trends(stored["vectors"], stored["posts"], [1])
    rows = lambda frame: sorted((r.topic_id, r.created_date, round(r.value, 9)) for r in frame.collect())
    assert rows(few) == rows(all_ways)


def test_gram_matrix_keeps_the_splits(spark):
    from newsloom.operators import similarity as G

    vectors = spark.range(0, 400, 1, 37).select(F.array(F.lit(0.25), F.lit(0.75)).alias("shares"))
    cells = G.gram_cells(vectors, "shares")
    assert "Coalesce" not in plan_of(cells)
    assert {(r.i, r.j, round(r.dot, 6), r.both) for r in cells.collect()} == {(0, 0, 25.0, 400), (0, 1, 75.0, 400), (1, 1, 225.0, 400)}


def test_gram_matrix_moves_tiles(spark, monkeypatch):
    """A row per tile and split, in a tree of sums, and the cells of the whole matrix at the end."""
    import numpy as np

    from newsloom.operators import similarity as G

    monkeypatch.setattr(G, "TILE", 7)
    monkeypatch.setattr(G, "FAN_IN", 3)
    shares = np.random.default_rng(1).random((120, 20)).round(3)
    vectors = spark.createDataFrame([([float(x) for x in row],) for row in shares], "shares array<double>").repartition(11)
    assert G._tiles(np.zeros((20, 20)), np.zeros((20, 20)), 0).num_rows == 6  # instead of 210 cells
    cells = {(r.i, r.j): (r.dot, r.both) for r in G.gram_cells(vectors, "shares", 0.5).collect()}
    above = (shares > 0.5).astype(int)
    assert set(cells) == {(i, j) for i in range(20) for j in range(i, 20)}
    for (i, j), (dot, both) in cells.items():
        assert abs(dot - shares[:, i] @ shares[:, j]) < 1e-9 and both == above[:, i] @ above[:, j]
    assert G.gram_cells(vectors.limit(0), "shares").count() == 0


def test_top_words_are_limited_before_the_shuffle(spark):
    words = spark.range(100).selectExpr("cast(id % 3 as int) as topic_id", "cast(id as string) as term", "rand() as weight")
    plan = plan_of(E.top_words(words))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_no_operator_pairs_all_rows(spark, stored):
    words = spark.range(100).selectExpr("cast(id % 2 as int) as topic_id", "cast(id as string) as term", "1.0D as weight")
    from newsloom.operators import similarity as G

    sims = G.topic_similarities(stored["vectors"], words, 2)
    for frame in (sims, G.common_topics(sims, 2), G.heat_map(sims), R.topic_scores(stored["by_topic"], 2)):
        plan = plan_of(frame)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

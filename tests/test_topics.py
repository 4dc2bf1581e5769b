import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsloom.functions.quantiles import grouped_percentile
from newsloom.operators import articles as A
from newsloom.operators import ranking as R
from newsloom.operators import similarity as G
from newsloom.operators import topic_model as E
from newsloom.operators import trends as T


def vectors_table(spark, shares):
    return spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(shares)], "id long, shares array<double>"
    )


def words_table(spark, weights):
    return spark.createDataFrame(
        [(t, f"w{v}", float(w)) for t, row in enumerate(weights) for v, w in enumerate(row)],
        "topic_id int, term string, weight double",
    )


def random_shares(seed, n=80, k=6):
    return np.random.default_rng(seed).dirichlet([0.3] * k, n)


# Percentiles


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.85, 1.0])
@pytest.mark.parametrize("bins", [1, 7, 1 << 16])
def test_percentile_equals_numpy(spark, q, bins):
    rng = random.Random(1)
    groups = {
        0: [rng.random() for _ in range(101)],
        1: [rng.random() for _ in range(100)],
        2: [0.5] * 40 + [0.25] * 3,
        3: [0.0, 1.0],
        4: [0.3],
        5: [0.1 + 1e-9 * i for i in range(50)],
    }
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k int, v double")
    found = {r.k: r.percentile for r in grouped_percentile(rows, "k", "v", q, 0.0, 1.0, bins).collect()}
    assert found == {k: pytest.approx(np.percentile(v, q * 100), abs=1e-15) for k, v in groups.items()}


# Articles and topics


def test_bounds_of_topic_articles(spark):
    topics = E.long_topics(vectors_table(spark, [[0.1, 0.9], [0.10001, 0.89999], [0.5, 0.5], [0.5, 0.5]]))
    assert [(r.id) for r in R.topic_articles(topics, 0).collect()] == [2, 3, 1]
    assert [r.id for r in R.topic_articles(topics, 0, top_n=2).collect()] == [2, 3]
    assert [r.id for r in R.topic_articles(topics, 0, negative_ids=[1], min_prob=0.1).collect()] == []


def test_mean_share_counts_absent_as_zero(spark):
    sparse = spark.createDataFrame([(1, 0, 0.6), (2, 0, 0.3), (2, 1, 0.5), (3, 1, 0.1)], "id long, topic_id int, prob double")
    found = [(r.id, r.prob) for r in R.topic_articles(sparse, [0, 1], min_prob=0.1).collect()]
    assert found == [(2, pytest.approx(0.4)), (1, pytest.approx(0.3))]
    twice = {r.id: r.prob for r in R.topic_articles(sparse, [0, 0, 1], min_prob=0.1).collect()}
    assert twice == {1: pytest.approx(0.4), 2: pytest.approx(1.1 / 3)}


def test_article_topics_rank_inside_the_row(spark):
    rows = E.article_topics(vectors_table(spark, [[0.2, 0.5, 0.2, 0.1], [0.1, 0.1, 0.1, 0.7], [0, 0, 0, 0]])).collect()
    assert [(r.id, r["rank"], r.topic_id, r.prob) for r in rows] == [
        (0, 1, 1, 0.5), (0, 2, 0, 0.2), (0, 3, 2, 0.2), (1, 1, 3, 0.7),
    ]


def test_scores_are_medians_from_a_tenth(spark):
    shares = [[0.1, 0.0, 0.9], [0.3, 0.05, 0.65], [0.05, 0.05, 0.9]]
    scores = R.topic_scores(E.long_topics(vectors_table(spark, shares)), 3)
    assert {r.topic_id: r.score for r in scores.collect()} == {0: pytest.approx(0.2), 1: None, 2: pytest.approx(0.9)}
    labels = E.top_words(words_table(spark, [[3, 2, 1], [1, 2, 3], [1, 1, 1]]), 2)
    table = R.topics_table(scores, labels).collect()
    assert [(r["rank"], r.topic_id, r.label) for r in table] == [(1, 2, "w0, w1"), (2, 0, "w0, w1"), (3, 1, "w2, w1")]
    assert [r.topic_id for r in R.topics_table(scores, labels, [1, 0]).collect()] == [1, 0]


def posts_and_texts(spark, n):
    day = dt.datetime(2016, 1, 1)
    posts = [(i, f"t{i}", f"u{i}", 40 + i, "x", day + dt.timedelta(days=i // 2)) for i in range(n)]
    frame = spark.createDataFrame(
        posts, "id long, title string, url string, num_points int, author string, created_at timestamp"
    ).withColumn("created_date", F.to_date("created_at"))
    return frame, spark.createDataFrame([(i, f"text {i} é" * 50) for i in range(n)], "id long, text string")


def test_shown_articles(spark):
    shares = random_shares(2, 40)
    topics = E.long_topics(vectors_table(spark, shares))
    posts, texts = posts_and_texts(spark, 40)
    near = [tuple(r) for r in R.show_topic_articles(topics, posts, texts, [0, 1], top_n=4).collect()]
    assert len(near) == 4
    # An article without a post or text keeps its place.
    ids = [r[0] for r in near]
    rows = R.show_topic_articles(topics, posts.where(f"id <> {ids[0]}"), texts.where(f"id <> {ids[1]}"), [0, 1], top_n=4).collect()
    assert [r.id for r in rows] == ids and rows[0].title is None and rows[1].snippet is None
    assert all(len(r[4].encode()) <= 500 for r in near)
    assert R.show_topic_articles(topics, posts, texts, 0, min_prob=2.0, top_n=4).collect() == []


def test_article_filters(spark):
    posts, texts = posts_and_texts(spark, 20)
    assert [r.id for r in A.stream_articles(texts, posts).orderBy("id").collect()] == list(range(10, 20))
    assert A.stream_articles(texts, posts, max_count=12).count() == 2
    assert A.stream_articles(texts).count() == 20
    assert A.metadata_problems(texts, posts).collect() == []
    problems = A.metadata_problems(texts, posts.where("id > 2").union(posts.where("id > 17"))).collect()
    assert {tuple(r) for r in problems} == {("no post", 3), ("repeated post", 2)}
    wanted = spark.createDataFrame([(5, 0), (3, 1), (5, 2), (99, 3)], "id long, pos long")
    assert [r.id for r in A.posts_by_ids(posts, wanted).collect()] == [5, 3, 5]
    assert [r.id for r in A.ids_without_post(wanted, posts).collect()] == [99]
    assert A.long_enough(texts, None).count() == 20


# Similarity


def brute_similarities(shares, weights, threshold=0.15):
    def cosine(rows):
        norms = np.linalg.norm(rows, axis=1)
        norms[norms == 0] = 1
        return rows @ rows.T / norms[:, None] / norms

    doc, word = cosine(shares.T), cosine(weights)
    over = (shares > threshold).astype(float)
    both = over.T @ over
    union = both.diagonal()[:, None] + both.diagonal() - both
    with np.errstate(invalid="ignore", divide="ignore"):
        jaccard = both / union
    d, w = doc.copy(), word.copy()
    np.fill_diagonal(d, 0)
    np.fill_diagonal(w, 0)
    return {"doc_sim": doc, "word_sim": word, "jaccard": jaccard, "word_doc_sim": (d.max() / w.max() * w + d) / 2}


def matrix_of(frame, k, column="sim"):
    out = np.full((k, k), np.nan)
    for r in frame.collect():
        if r[column] is not None:
            out[r.i, r.j] = r[column]
    return out


@pytest.fixture(scope="module")
def similarity_case(spark):
    shares = random_shares(4)
    shares[:, 5] = 0.0  # a topic without articles
    shares[:, 4] = np.minimum(shares[:, 4], 0.15)  # no article above the bound
    weights = np.random.default_rng(5).random((6, 30))
    weights[2] = 0
    sims = G.topic_similarities(
        vectors_table(spark, shares).repartition(5), words_table(spark, weights), 6
    ).cache()
    return shares, weights, sims


def test_similarities_equal_numpy(similarity_case):
    shares, weights, sims = similarity_case
    assert sims.count() == 36
    for metric, wanted in brute_similarities(shares, weights).items():
        np.testing.assert_allclose(matrix_of(sims, 6, metric), wanted, atol=1e-11, err_msg=metric)


def test_matrices_are_symmetric(similarity_case):
    sims = similarity_case[2]
    for metric in G.METRICS:
        m = matrix_of(sims, 6, metric)
        assert np.array_equal(m, m.T, equal_nan=True)


def test_unknown_metric(similarity_case):
    with pytest.raises(ValueError, match="unknown similarity metric"):
        G.similarity_matrix(similarity_case[2], "cosine")


def test_common_standalone_and_threshold(similarity_case):
    sims = similarity_case[2]
    m = matrix_of(sims, 6, "doc_sim")
    np.fill_diagonal(m, 0)
    for p in (50, 85):
        bound = np.percentile(m, p)
        counts = (m >= bound).sum(axis=1)
        wanted = [(t, counts[t]) for t in sorted(range(6), key=lambda t: (-counts[t], t)) if counts[t] >= 0.2 * 6]
        found = G.common_topics(sims, 6, "doc_sim", threshold_percentile=p).collect()
        assert [tuple(r) for r in found] == wanted
        alone = [r.topic_id for r in G.standalone_topics(sims, "doc_sim", threshold_percentile=p).collect()]
        assert alone == [t for t in range(6) if (m[t] <= bound).all()]
        cut = np.where(m <= bound, 0, m)
        np.testing.assert_array_equal(matrix_of(G.heat_map(sims, "doc_sim", p), 6), cut)
    plain = G.similarity_matrix(sims, "doc_sim")
    assert G.threshold_matrix(plain, None) is plain


def test_similar_topics_keep_the_best(similarity_case):
    sims = similarity_case[2]
    m = matrix_of(sims, 6, "word_doc_sim")
    best = sorted((t for t in range(6) if t != 1), key=lambda t: (-m[1, t], t))
    assert [r.topic_id for r in G.similar_topics(sims, 1, top_n=3).collect()] == best[:3]
    assert all(r.sim >= 0.2 for r in G.similar_topics(sims, 1, min_similarity=0.2).collect())
    pairs = G.similar_pairs(sims, top_n=100).collect()
    assert len(pairs) == 15 and all(p.i > p.j for p in pairs)
    assert [p.sim for p in pairs] == sorted((p.sim for p in pairs), reverse=True)


# Trends


@pytest.mark.parametrize("window", [5, 30])
def test_rolling_mean_equals_pandas(spark, window):
    values = [float(i * i % 17) for i in range(40)]
    day = dt.date(2016, 1, 1)
    frame = spark.createDataFrame([(day + dt.timedelta(days=3 * i), v) for i, v in enumerate(values)], "d date, v double")
    found = frame.withColumn("r", T.centred_mean("v", [], "d", window)).orderBy("d").toPandas()["r"]
    wanted = pd.Series(values).rolling(window, center=True).mean()
    np.testing.assert_allclose(found.astype(float), wanted)
    if window == 30:
        assert found.first_valid_index() == 15 and found.last_valid_index() == 25


def test_trend_has_only_days_with_articles(spark):
    shares = [[0.1, 0.9], [0.6, 0.4], [0.7, 0.3], [0.05, 0.95], [0.8, 0.2], [0.9, 0.1]]
    posts, texts = posts_and_texts(spark, 6)
    trend = T.topic_trends(vectors_table(spark, shares), posts, 0, window_size=None).orderBy("created_date").collect()
    assert [(r.created_date.day, round(r.value, 9)) for r in trend] == [(1, 0.6), (2, 0.7), (3, 1.7)]
    slices = T.time_slices(posts, texts).collect()
    assert [(str(r.month), r.n) for r in slices] == [("2016-01-01", 6)]
    assert [r.id for r in T.ids_by_time(posts, texts.where("id <> 3"), 4).collect()] == [0, 1, 2, 4]


def fails(frame, message):
    with pytest.raises(Exception, match=message):
        frame.collect()


def test_slices_add_up_or_fail(spark):
    posts, texts = posts_and_texts(spark, 6)
    fails(T.time_slices(posts.unionAll(posts.where("id = 2")), texts), "article 2 has no single date")
    undated = posts.withColumn("created_at", F.when(F.col("id") != 4, F.col("created_at")))
    fails(T.time_slices(undated, texts), "article 4 has no single date")
    # Posts without a text are no articles.
    assert T.time_slices(undated, texts.where("id <> 4")).agg(F.sum("n")).first()[0] == 5


def test_exactly_one_post_per_text(spark):
    posts, texts = posts_and_texts(spark, 6)
    valid = A.with_metadata(texts, posts)
    assert valid.count() == 6 and valid.columns == ["id", "text", *A.POST_FIELDS]
    fails(A.with_metadata(texts, posts.where("id <> 3")), "article 3 has 0 posts")
    fails(A.with_metadata(texts, posts.unionAll(posts.where("id = 1"))), "article 1 has 2 posts")
    # The check cannot be pruned away, and a post without a text is no fault.
    fails(A.with_metadata(texts, posts.where("id <> 3")).select("id"), "article 3 has 0 posts")
    fails(A.with_metadata(texts, posts.where("id <> 3")).groupBy().count(), "article 3 has 0 posts")
    assert A.with_metadata(texts.where("id > 2"), posts.unionAll(posts.where("id = 1"))).count() == 3
    plan = valid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_topics_of_articles_without_post_or_text(spark):
    shares = random_shares(2, 4)
    posts, texts = posts_and_texts(spark, 4)
    labels = spark.createDataFrame([(0, "zero")], "topic_id int, label string")
    shown = R.show_article_topics(vectors_table(spark, shares), posts.where("id <> 1"), texts.where("id <> 2"), labels, [1, 2, 3], min_prob=0.0).collect()
    assert {r.id for r in shown} == {1, 2, 3}
    assert {(r.id, r.title is None, r.snippet is None) for r in shown} == {(1, True, False), (2, False, True), (3, False, False)}
    assert {r.topic_id: r.label for r in shown} == {0: "zero"} | dict.fromkeys({r.topic_id for r in shown} - {0})


def test_best_articles_of_topics_read_high_shares_only(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    shares = rng.dirichlet([0.08] * 6, size=3000)
    shares[:40] = [0.4, 0.38, 0.1, 0.05, 0.04, 0.03]
    shares[:40, 0] += np.arange(40) * 1e-4
    E.write_topics(vectors_table(spark, shares.tolist()), str(tmp_path))
    by_topic, by_article = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("by_topic", "by_article"))
    wholes = []
    real = R.topic_articles
    monkeypatch.setattr(R, "topic_articles", lambda *a, **k: wholes.append(1) or real(*a, **k))
    for topics, top_n, min_prob in (([0, 1], 10, 0.1), ([0, 1], 60, 0.1), ([2, 3, 3], 5, 0.1), ([0, 1, 2, 3, 4, 5], 7, 0.05), ([0, 1], 5000, 0.01)):
        found = [(r.id, round(r.prob, 9)) for r in R.best_articles_of_topics(by_topic, by_article, topics, top_n, min_prob).collect()]
        wanted = [(r.id, round(r.prob, 9)) for r in real(by_topic, topics, min_prob, top_n=top_n).collect()]
        assert found == wanted
    assert len(wholes) == 2  # only where all that is above the bound was asked for, or nothing is above it
    wholes.clear()
    monkeypatch.setattr(R, "MAX_LOOKED_UP", 3)
    assert R.best_articles_of_topics(by_topic, by_article, [0, 1], 5).count() == 5 and wholes


def test_row_groups_below_the_bound_are_not_read(spark, tmp_path):
    import pyarrow.parquet as pq

    shares = np.random.default_rng(5).dirichlet([0.08] * 6, size=20000)
    shares[:40] = [0.5, 0.5, 0, 0, 0, 0]
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "60"}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():  # many small files, as a large table has many row groups
        spark.conf.set(name, value)
    E.write_topics(vectors_table(spark, shares.tolist()), str(tmp_path))
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    groups = []
    for file in sorted((tmp_path / "by_topic").glob("*.parquet")):
        meta = pq.ParquetFile(file).metadata
        for k in range(meta.num_row_groups):
            topic, prob = (meta.row_group(k).column(c).statistics for c in (meta.schema.names.index("topic_id"), meta.schema.names.index("prob")))
            groups.append((topic.min, topic.max, prob.max))
    read = lambda bound: sum(low <= 1 and high >= 0 and most >= bound for low, high, most in groups)
    by_topic = spark.read.parquet(f"{tmp_path}/by_topic")
    seen = by_topic.where("topic_id in (0, 1) and prob >= 0.5")
    assert "PushedFilters: [" in seen._jdf.queryExecution().executedPlan().toString()
    assert read(0.5) <= 0.5 * read(0.0) and read(0.0) <= 0.5 * len(groups)
    best = R.best_articles_of_topics(by_topic, spark.read.parquet(f"{tmp_path}/by_article"), [0, 1], 20)
    assert {r.id for r in best.collect()} <= {r.id for r in seen.collect()}


def test_histogram_keeps_empty_bins(spark):
    shares = [[0.05, 0.95], [0.051, 0.949], [0.3, 0.7], [1.0, 0.0]]
    found = T.share_histogram(E.long_topics(vectors_table(spark, shares)), [0, 7]).collect()
    counts = {(r.topic_id, r.bin): r.n for r in found}
    assert len(counts) == 20 and sum(n for (t, _), n in counts.items() if t == 7) == 0
    assert {b: n for (t, b), n in counts.items() if t == 0 and n} == {0: 1, 3: 1, 9: 1}

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import topic_model as E
from newsloom.operators.features import tokenise
from newsloom.plans import ArticleCorpus, TopicExplorer
from newsloom.streaming import read_article_stream, tag_stream, write_tags

GROUPS = ("apple pear plum fig lime", "iron zinc lead tin gold", "rain snow hail fog wind")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choices(GROUPS[i % 3].split(), k=30))) for i in range(150)]
    texts = spark.createDataFrame(rows, "id long, text string")
    posts = texts.select(
        "id",
        F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"),
        F.lit("http://x").alias("url"),
        F.lit(60).alias("num_points"),
        F.lit("ann").alias("author"),
        F.date_add(F.lit("2016-01-01").cast("date"), (F.col("id") % 40).cast("int")).cast("timestamp").alias("created_at"),
    ).withColumn("created_date", F.to_date("created_at"))
    return ArticleCorpus(texts, posts, tokens_path=str(tmp_path_factory.mktemp("corpus") / "tokens"))


def best_of(corpus, seeds, optimizer, **params):
    """Training can end in a local optimum, so the most likely of a few models is taken."""
    bags = corpus.bags_of_words().cache()
    models = [corpus.train(3, optimizer, seed=seed, **params) for seed in seeds]
    return min(models, key=lambda model: model.lda.logPerplexity(bags))


@pytest.fixture(scope="module")
def model(corpus):
    return best_of(corpus, range(4), "online", maxIter=40, subsamplingRate=0.5, docConcentration=[0.1], topicConcentration=0.1)


def test_training_is_repeatable(spark, corpus):
    def weights():
        trained = corpus.train(3, maxIter=3, seed=5)
        return sorted(tuple(r) for r in E.topic_words(trained, spark).collect())

    assert weights() == weights()


def check_separated(corpus, model):
    found = E.article_topics(E.infer_topics(model, corpus.tokens()), 0.8).collect()
    assert len(found) == 150
    by_group = {}
    for r in found:
        by_group.setdefault(r.id % 3, set()).add(r.topic_id)
    assert sorted(len(topics) for topics in by_group.values()) == [1, 1, 1]
    assert len(set.union(*by_group.values())) == 3


def test_online_training_separates_vocabularies(corpus, model):
    check_separated(corpus, model)


def test_em_training_separates_vocabularies(corpus):
    check_separated(corpus, best_of(corpus, range(2), "em", maxIter=40, docConcentration=[1.1], topicConcentration=1.1))


def test_labels_name_the_groups(spark, model):
    labels = E.top_words(E.topic_words(model, spark), 5).collect()
    assert {frozenset(r.words) for r in labels} == {frozenset(g.split()) for g in GROUPS}


def test_topic_words_are_normalised(spark, model):
    totals = E.topic_words(model, spark, normalised=True).groupBy("topic_id").agg(F.sum("weight").alias("s"))
    assert [r.s for r in totals.collect()] == [pytest.approx(1.0)] * 3


def test_unknown_words(spark, model):
    texts = spark.createDataFrame([(1, "qqq zzz"), (2, ""), (3, "apple fig pear"), (4, None)], "id long, text string")
    rows = {r.id: r for r in E.infer_topics(model, tokenise(texts)).collect()}
    assert rows[4].shares == [0, 0, 0]
    assert rows[1].shares == [0, 0, 0] and not rows[1].has_terms and not rows[2].has_terms
    assert sum(rows[3].shares) == pytest.approx(1) and rows[3].has_terms
    assert {r.id for r in E.tag_texts(model, texts).collect()} == {3}


def test_model_round_trip(spark, corpus, model, tmp_path):
    model.save(str(tmp_path / "model"))
    loaded = E.TopicModel.load(spark, str(tmp_path / "model"))
    assert loaded.num_topics == 3 and loaded.phrases is None
    before = {r.id: r.shares for r in E.infer_topics(model, corpus.tokens()).collect()}
    after = {r.id: r.shares for r in E.infer_topics(loaded, corpus.tokens()).collect()}
    assert after == {i: pytest.approx(s) for i, s in before.items()}


def test_phrases_belong_to_the_model(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"new york {'ab'[i % 2]} " * 5) for i in range(40)], "id long, text string")
    corpus = ArticleCorpus(texts)
    corpus.learn_phrases(min_count=5, threshold=0.01)
    merged = corpus.train(2, maxIter=3, subsamplingRate=1.0, seed=1)
    assert any("_" in term for term in merged.vectoriser.vocabulary)
    merged.save(str(tmp_path / "model"))
    loaded = E.TopicModel.load(spark, str(tmp_path / "model"))
    tagged = sorted(tuple(r) for r in E.tag_texts(merged, texts).collect())
    assert tagged and [tuple(r) for r in tagged] == sorted(tuple(r) for r in E.tag_texts(loaded, texts).collect())
    # Phrases are merged on streams too.
    texts.write.parquet(str(tmp_path / "arriving"))
    stream = tag_stream(loaded, read_article_stream(spark, str(tmp_path / "arriving")))
    write_tags(stream, str(tmp_path / "tags"), str(tmp_path / "progress"), available_now=True).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "tags")).collect()) == tagged


def lemma_model(spark, model):
    lemmas = spark.createDataFrame([("apples", "apple"), ("pears", "pear"), ("pears", "zzz")], "form string, lemma string")
    return E.TopicModel(model.vectoriser, model.lda, lemmas=lemmas)


def test_lemmas_belong_to_the_model(spark, model, tmp_path):
    texts = spark.createDataFrame([(1, "apples pears apples"), (2, "plums")], "id long, text string")
    assert E.tag_texts(model, texts).count() == 0
    own = lemma_model(spark, model)
    tagged = sorted(tuple(r) for r in E.tag_texts(own, texts).collect())
    plain = spark.createDataFrame([(1, "apple pear apple"), (2, "plums")], "id long, text string")
    assert tagged and tagged == sorted(tuple(r) for r in E.tag_texts(model, plain).collect())
    own.save(str(tmp_path / "model"))
    loaded = E.TopicModel.load(spark, str(tmp_path / "model"))
    texts.write.parquet(str(tmp_path / "arriving"))
    stream = tag_stream(loaded, read_article_stream(spark, str(tmp_path / "arriving")))
    write_tags(stream, str(tmp_path / "tags"), str(tmp_path / "progress"), available_now=True).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "tags")).collect()) == tagged


def test_saving_again_leaves_nothing_of_the_older_model(spark, model, tmp_path):
    path = str(tmp_path / "model")
    phrases = spark.createDataFrame([("apple", "pear")], "w1 string, w2 string")
    E.TopicModel(model.vectoriser, model.lda, phrases).save(path)
    loaded = E.TopicModel.load(spark, path)
    assert loaded.phrases.count() == 1
    model.save(path)
    assert E.TopicModel.load(spark, path).phrases is None
    # A loaded model can be saved to its own path.
    loaded.save(path)
    assert E.TopicModel.load(spark, path).phrases.count() == 1


def test_stream_equals_batch(spark, corpus, model, tmp_path):
    arriving, tags = str(tmp_path / "arriving"), str(tmp_path / "tags")
    corpus.texts.repartition(6).write.parquet(arriving)
    stream = tag_stream(model, read_article_stream(spark, arriving, max_files_per_trigger=2))
    for _ in range(2):  # the second start finds nothing new
        write_tags(stream, tags, str(tmp_path / "progress"), available_now=True).awaitTermination()
    streamed = sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(tags).collect())
    assert streamed == sorted(tuple(r) for r in E.tag_texts(model, corpus.texts).collect())


def test_explorer_answers(spark, corpus, model, tmp_path):
    explorer = TopicExplorer.from_model(corpus, model, str(tmp_path / "tables"))
    assert explorer.topics_table().count() == 3
    assert explorer.topic_articles(0, top_n=5).count() == 5
    shown = explorer.show_topic_articles([0], top_n=5).collect()
    assert len(shown) == 5 and shown[0].title.startswith("title")
    assert explorer.article_topics(7).count() >= 1
    assert explorer.show_article_topics([7, 8]).select("id").distinct().count() == 2
    assert explorer.topic_trends(0, window_size=5).count() > 0
    assert explorer.topic_trend_series(0, window_size=5).first().name == "Topic #0"
    assert explorer.share_histogram([0, 1]).count() == 20
    assert explorer.similar_topics(0, top_n=1).count() == 1
    assert explorer.show_similar_topics(0, top_n=2).count() == 2
    assert explorer.similar_pairs().count() == 3
    assert explorer.show_similar_pairs(top_n=2).first().label_i
    assert explorer.heat_map().count() == 9
    clusters = explorer.cluster_topics(n_clusters=2)
    assert explorer.clusters_table(clusters).count() == 3
    assert explorer.clustered_heat_map(clusters).count() == 9
    page = spark.createDataFrame([(1, "http://p", f"<p>{GROUPS[0]}</p>")], "page_id long, url string, html string")
    tagged = explorer.show_page_topics(page, min_prob=0.5).collect()
    assert len(tagged) == 1 and set(tagged[0].words) >= set(GROUPS[0].split())


def test_corpus_by_time(corpus):
    assert corpus.time_slices().count() == 2
    assert corpus.ids_by_time(10).count() == 10
    assert corpus.tokens_by_time().select("slice").distinct().count() == 2
    assert corpus.bags_by_time().count() == 150
    first = [r.id for r in corpus.ids_by_time(10).collect()]
    assert {r.id for r in corpus.tokens_by_time(10).collect()} == set(first)
    assert {r.id for r in corpus.bags_by_time(10).collect()} == set(first)
    assert [r.id for r in corpus.get_posts([9, 2]).collect()] == [9, 2]
    assert corpus.article_counts(corpus.texts.select("id")).count() == 40


def test_explorer_without_posts(corpus, model, spark):
    explorer = TopicExplorer(E.infer_topics(model, corpus.tokens()), E.topic_words(model, spark), 3)
    with pytest.raises(ValueError, match="metadata"):
        explorer.show_topic_articles([0])


def test_corpus_without_posts(spark):
    with pytest.raises(ValueError, match="metadata"):
        ArticleCorpus(spark.createDataFrame([(1, "a")], "id long, text string")).time_slices()

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions.staging import path_exists
from newsloom.operators import features as C
from newsloom.operators import topic_model as E
from newsloom.operators import topic_sampling as S
from newsloom.operators import topic_tables as T
from newsloom.plans import ArticleCorpus, TopicExplorer
from newsloom.streaming import read_article_stream, tag_in_batches, tag_stream

GROUPS = ("apple pear plum fig lime", "iron zinc lead tin gold", "rain snow hail fog wind")


# --- one part ---


def test_digamma():
    x = np.array([1e-3, 0.1, 1.0, 2.5, 7.0, 1e6])
    assert S.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-9)
    assert np.allclose(S.digamma(x + 1), S.digamma(x) + 1 / x, rtol=1e-8)


def planted(generator, num_topics, num_terms, documents, longest):
    own = num_terms // num_topics
    codes, sizes = [], []
    for _ in range(documents):
        shares = generator.dirichlet([0.1] * num_topics)
        n = int(generator.integers(1, longest))
        codes.append(generator.choice(num_topics, n, p=shares) * own + generator.integers(own, size=n))
        sizes.append(n)
    return np.concatenate(codes), np.concatenate(([0], np.cumsum(sizes)))


@pytest.mark.parametrize(("lanes", "stretch"), [(1, 1000), (7, 5), (256, 512)])
def test_a_sweep_keeps_counts(lanes, stretch):
    generator = np.random.default_rng(3)
    codes, bounds = planted(generator, 4, 40, 60, 50)
    topics = generator.integers(4, size=len(codes))
    counts = S.topic_counts(codes, topics, 40, 4)
    totals = counts.sum(axis=0)
    before = topics.copy()
    for _ in range(3):
        S.gibbs_sweep(codes, bounds, topics, counts, totals, np.full(4, 0.1), 0.01, 40, generator, lanes, stretch)
    assert (before != topics).any()
    assert (counts == S.topic_counts(codes, topics, 40, 4)).all()
    assert (totals == counts.sum(axis=0)).all()


def test_draws_follow_the_conditional():
    """The first token's new topic, against its weights given all other tokens."""
    codes = np.array([0, 1, 1, 2, 0, 0, 2, 1, 2, 2])
    bounds = np.array([0, 5, 10])
    topics = np.array([0, 1, 1, 3, 0, 1, 2, 0, 3, 3])
    alpha, beta, terms = np.array([0.5, 0.1, 0.2, 1.0]), 0.3, 3
    counts = S.topic_counts(codes, topics, terms, 4)
    weights = np.zeros(4)
    for k in range(4):
        others = np.arange(1, 10)
        in_doc = (topics[1:5] == k).sum()
        of_word = ((codes[others] == 0) & (topics[others] == k)).sum()
        weights[k] = (in_doc + alpha[k]) * (of_word + beta) / ((topics[others] == k).sum() + terms * beta)
    generator, drawn = np.random.default_rng(1), np.zeros(4)
    for _ in range(2500):
        own = topics.copy()
        S.gibbs_sweep(codes, bounds, own, counts.copy(), counts.sum(axis=0), alpha, beta, terms, generator, lanes=1)
        drawn[own[0]] += 1
    assert np.allclose(drawn / 2500, weights / weights.sum(), atol=0.04)


def test_sampling_finds_planted_topics_and_their_prior():
    generator = np.random.default_rng(5)
    codes, bounds = planted(generator, 5, 200, 300, 100)
    topics = generator.integers(5, size=len(codes))
    counts, alpha = S.topic_counts(codes, topics, 200, 5), np.full(5, 2.0)
    totals = counts.sum(axis=0)
    for _ in range(60):
        S.gibbs_sweep(codes, bounds, topics, counts, totals, alpha, 0.01, 200, generator)
        alpha = S.next_alpha(alpha, S.alpha_statistics(bounds, topics, alpha))
    blocks = counts.reshape(5, 40, 5).sum(axis=1)
    assert blocks.max(axis=1).sum() / blocks.sum() > 0.9
    assert alpha.max() < 0.5


def plain_variational(codes, n, weights, alpha):
    gamma = alpha + n.sum() / len(alpha)
    for _ in range(S.MAX_STEPS):
        theta = np.exp(S.digamma(gamma) - S.digamma(gamma.sum()))
        new = alpha + theta * (weights[codes] * (n / (weights[codes] @ theta))[:, None]).sum(axis=0)
        change, gamma = np.abs(new - gamma).mean(), new
        if change < S.TOLERANCE:
            break
    return gamma


def test_variational_steps_of_a_document_do_not_depend_on_others(monkeypatch):
    generator = np.random.default_rng(2)
    weights, alpha = generator.dirichlet([0.2] * 30, size=4).T + 1e-6, np.full(4, 0.3)
    sizes = generator.integers(0, 12, size=50)
    codes = np.concatenate([generator.choice(30, s, replace=False) for s in sizes])
    n, bounds = generator.integers(1, 5, size=len(codes)), np.concatenate(([0], np.cumsum(sizes)))
    together, statistics = None, np.zeros((30, 4))
    together = S.variational(codes, n, bounds, weights, alpha, statistics)
    assert statistics.sum() == pytest.approx(n.sum())
    assert np.allclose(statistics.sum(axis=1), np.bincount(codes, weights=n, minlength=30))
    monkeypatch.setattr(S, "ENTRIES", 16)
    assert np.allclose(together, S.variational(codes, n, bounds, weights, alpha))
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        wanted = plain_variational(codes[a:b], n[a:b], weights, alpha) if b > a else alpha
        assert np.allclose(together[i], wanted)


# --- on Spark ---


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choices(GROUPS[i % 3].split(), k=30))) for i in range(150)]
    return ArticleCorpus(spark.createDataFrame(rows, "id long, text string"), tokens_path=str(tmp_path_factory.mktemp("tables") / "tokens"))


OPTIONS = {"gibbs": {"iterations": 40, "sweeps_per_merge": 8, "optimize_interval": 2, "alpha": 0.1}, "variational": {"iterations": 8, "alpha": 0.1, "beta": 0.1}}


@pytest.fixture(scope="module", params=["gibbs", "variational"])
def model(request, corpus):
    return corpus.train(3, request.param, seed=4, **OPTIONS[request.param])


def test_both_trainers_separate_vocabularies(spark, corpus, model):
    found = E.article_topics(E.infer_topics(model, corpus.tokens()), 0.8).collect()
    assert len(found) == 150
    topics = [{r.topic_id for r in found if r.id % 3 == g} for g in range(3)]
    assert sorted(len(t) for t in topics) == [1, 1, 1] and len(set.union(*topics)) == 3
    labels = E.top_words(E.topic_words(model, spark), 5).collect()
    assert {frozenset(r.words) for r in labels} == {frozenset(g.split()) for g in GROUPS}


def test_every_token_is_in_a_topic(corpus, model):
    occurrences = {r.term: r.tf for r in C.build_vocabulary(corpus.tokens()).collect()}
    assert {r.term: pytest.approx(sum(r["values"])) for r in model.weights.collect()} == occurrences
    assert sum(model.totals) == pytest.approx(150 * 30)


def test_topic_words_have_all_cells(spark, model):
    words = E.topic_words(model, spark, normalised=True)
    assert words.count() == 45
    assert [r.s for r in words.groupBy("topic_id").agg(F.sum("weight").alias("s")).collect()] == [pytest.approx(1.0)] * 3


def weights_of(found):
    return {(r.term, k): v for r in found.weights.collect() for k, v in zip(r.topics, r["values"], strict=True)}


def test_equal_seeds_give_equal_counts_in_any_order(spark, corpus):
    tokens = corpus.tokens()
    vocabulary = C.build_vocabulary(tokens)

    def train(rows, seed):
        return weights_of(T.train_tables(rows, vocabulary, 3, iterations=3, sweeps_per_merge=3, seed=seed, tokens_per_part=1000))

    first = train(tokens, 1)
    assert train(tokens.orderBy(F.desc("id")).repartition(3), 1) == first
    assert train(tokens, 2) != first


def test_variational_training_does_not_depend_on_parts(corpus, monkeypatch):
    """Also beyond what a model on the driver may have."""
    tokens = corpus.tokens()
    vocabulary = C.build_vocabulary(tokens)
    monkeypatch.setattr(C, "MAX_MODEL_TERMS", 3)
    with pytest.raises(ValueError, match="variational"):
        C.fit_vectoriser(tokens)

    def train(tokens_per_part):
        # The first topics are drawn part by part; here they are the same in all parts.
        return T.train_tables(tokens, vocabulary, 3, "variational", iterations=3, seed=1, tokens_per_part=tokens_per_part)

    def begun(kind, num_topics, seed):
        def begin(key, documents, known):
            state = real(kind, num_topics, seed)(key, documents, known).to_pylist()
            terms = [r["term"] for r in state if r["kind"] == T.TERM]
            first = np.array([[(hash_of(t) >> (8 * k)) % 7 + 1.0 for k in range(3)] for t in terms]).reshape(-1, 3)
            tables = [r for r in state if r["kind"] == T.DOCUMENT]
            rows = T.pa.Table.from_pylist(tables, schema=T.pa.schema(T.STATE_FIELDS))
            part = key[0].as_py()
            # Each part brings its share, so that the sum over parts is the same however many there are.
            sizes = np.array([sum(n for r in tables for c, n in zip(r["codes"], r["values"], strict=True) if c == i) for i in range(len(terms))])
            share = first * sizes[:, None]
            return T.pa.concat_tables([rows, T._term_rows(part, T.pa.array(terms, T.pa.string()), share), T._total_row(part, share.sum(axis=0))])

        return begin

    def hash_of(term):
        return int.from_bytes(term.encode()[:4].ljust(4, b"x"), "little")

    real = T._begin
    monkeypatch.setattr(T, "_begin", begun)
    whole, dealt = weights_of(train(10**9)), weights_of(train(300))
    assert set(whole) == set(dealt)
    assert all(dealt[key] == pytest.approx(value, rel=1e-6) for key, value in whole.items())


def test_priors_are_estimated(corpus):
    def alpha(interval):
        return corpus.train(3, "gibbs", iterations=24, sweeps_per_merge=8, optimize_interval=interval, alpha=5.0, seed=3).alpha

    assert alpha(0) == [5.0] * 3
    assert max(alpha(1)) < 5.0


def test_unknown_words_and_other_columns(spark, model):
    rows = [(1, "qqq zzz", 7, "a"), (2, "", 8, None), (3, "apple fig pear", 9, "b"), (None, None, 10, "c"), (3, "apple fig pear", 9, "b")]
    texts = spark.createDataFrame(rows, "id long, text string, part int, key string")
    tokens = texts.withColumn("tokens", F.coalesce(F.split("text", " "), F.array().cast("array<string>"))).drop("text")
    found = E.infer_topics(model, tokens.withColumnRenamed("key", "row"))
    assert found.columns == ["id", "part", "row", "shares", "has_terms"]
    rows = found.collect()
    assert len(rows) == 5
    by_id = {r.id: r for r in rows}
    assert by_id[1].shares == [0, 0, 0] and not by_id[1].has_terms and not by_id[2].has_terms and not by_id[None].has_terms
    assert sum(by_id[3].shares) == pytest.approx(1) and by_id[3].part == 9 and by_id[3].row == "b"


@pytest.mark.parametrize("model", ["variational"], indirect=True)
def test_round_trip_next_to_other_models(spark, corpus, model, tmp_path):
    path = str(tmp_path / "model")
    E.save_model(model, path)
    loaded = E.load_model(spark, path)
    assert isinstance(loaded, T.TopicTable) and loaded.alpha == model.alpha and loaded.kind == model.kind
    before = {r.id: r.shares for r in E.infer_topics(model, corpus.tokens()).collect()}
    assert {r.id: r.shares for r in E.infer_topics(loaded, corpus.tokens()).collect()} == before
    E.save_model(corpus.train(3, "online", maxIter=1, seed=1), path)
    assert isinstance(E.load_model(spark, path), E.TopicModel)


@pytest.mark.parametrize("model", ["gibbs"], indirect=True)
def test_explorer_over_a_table_model(corpus, model, tmp_path):
    explorer = TopicExplorer.from_model(corpus, model, str(tmp_path / "tables"))
    assert explorer.topics_table().count() == 3
    assert explorer.topic_articles(0, top_n=5).count() == 5
    assert isinstance(explorer.model, T.TopicTable)
    assert explorer.similar_pairs().count() == 3


@pytest.mark.parametrize("model", ["gibbs"], indirect=True)
def test_streams_are_tagged_in_batches(spark, corpus, model, tmp_path, monkeypatch):
    """Any model, with phrases and lemmas that are joined because they are too many for a row."""
    texts = corpus.texts.withColumn("text", F.regexp_replace("text", "apple", "apples"))
    lemmas = spark.createDataFrame([("apples", "apple")], "form string, lemma string")
    phrases = spark.createDataFrame([("qq", "zz")], "w1 string, w2 string")
    own = T.TopicTable(model.kind, model.weights, model.alpha, model.beta, model.totals, model.num_terms, phrases, lemmas)
    monkeypatch.setattr(C, "is_small", lambda df: False)
    wanted = sorted(tuple(r) for r in E.tag_texts(own, texts).collect())
    assert {r[0] for r in wanted} == set(range(150))
    arriving = str(tmp_path / "arriving")
    texts.repartition(5).write.parquet(arriving)
    stream = read_article_stream(spark, arriving, max_files_per_trigger=2)
    with pytest.raises(ValueError, match="tag_in_batches"):
        tag_stream(own, stream)
    for _ in range(2):  # the second start finds nothing new
        tag_in_batches(own, stream, str(tmp_path / "tags"), str(tmp_path / "progress"), available_now=True).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "tags")).drop("batch").collect()) == wanted


@pytest.mark.parametrize("kind", ["gibbs", "variational"])
def test_empty_collections(spark, kind):
    tokens = spark.createDataFrame([(1, ["a"])], "id long, tokens array<string>")
    for rows, terms in ((tokens.limit(0), ["a"]), (tokens, ["b"]), (tokens, [])):
        vocabulary = spark.createDataFrame([(t,) for t in terms], "term string")
        found = T.train_tables(rows, vocabulary, 2, kind, iterations=2)
        assert found.totals == [0.0, 0.0]
        assert found.weights.count() == len(terms)
        assert [r.has_terms for r in E.infer_topics(found, tokens).collect()] == [bool(terms == ["a"])]


def test_wrong_options(spark):
    tokens = spark.createDataFrame([(1, ["a"])], "id long, tokens array<string>")
    vocabulary = spark.createDataFrame([("a",)], "term string")
    for options in ({"kind": "x"}, {"num_topics": 0}, {"alpha": [1.0]}, {"sweeps_per_merge": 0}):
        with pytest.raises(ValueError):
            T.train_tables(tokens, vocabulary, **({"num_topics": 2} | options))


def test_parts_have_about_the_tokens_they_should(spark):
    rows = [(i, ["a", "b"] * 50) for i in range(40)]
    dealt = T._deal(spark.createDataFrame(rows, "id long, tokens array<string>"), 1000)
    sizes = dealt.groupBy("part").agg(F.sum(F.size("tokens")).alias("n")).collect()
    assert sum(r.n for r in sizes) == 4000 and max(r.n for r in sizes) < 3000


@pytest.mark.parametrize("kind", ["gibbs", "variational"])
def test_models_do_not_depend_on_buckets_and_leave_no_tokens(spark, corpus, monkeypatch, kind):
    tokens = corpus.tokens()
    vocabulary = C.build_vocabulary(tokens)
    made, real = [], T.scratch_path
    monkeypatch.setattr(T, "scratch_path", lambda session, name: made.append(real(session, name)) or made[-1])
    found = []
    for size in (T.BUCKET_BYTES, 64):
        monkeypatch.setattr(T, "BUCKET_BYTES", size)
        model = T.train_tables(tokens, vocabulary, 3, kind, iterations=3, seed=2, tokens_per_part=1000)
        found.append({r.term: dict(zip(r.topics, r["values"], strict=True)) for r in model.weights.collect()})
    assert found[0].keys() == found[1].keys() and len(found[0]) == 15
    for term, values in found[0].items():
        # What goes to the parts has 24 bits; sums of topics are the same but for their order.
        assert values.keys() == found[1][term].keys() and np.allclose(list(values.values()), list(found[1][term].values()), rtol=1e-4)
    assert any("dealt" in path for path in made) and not any(path_exists(spark, path) for path in made)


def test_parts_are_large_where_there_are_many():
    sizes = [T._parts(tokens, None, 10) for tokens in (0, 1 << 20, 1 << 22, 1 << 25, 1 << 30)]
    assert sizes == [1, 1, 4, 16, 256] and T._parts(1 << 30, None, 1000) == 1024

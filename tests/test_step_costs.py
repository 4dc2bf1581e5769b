"""What steps over documents cost when the vocabulary grows, and the two ways to draw a topic."""

import time
import tracemalloc

import numpy as np
import pytest
from test_topic_tables import planted, test_a_sweep_keeps_counts, test_draws_follow_the_conditional

from newsloom.operators import features as C
from newsloom.operators import lda_steps as L
from newsloom.operators import topic_model as E
from newsloom.operators import topic_sampling as S
from newsloom.workload import model_queries as M


def drawn_in(monkeypatch, dense):
    monkeypatch.setattr(S, "DENSE_TOPICS", dense)
    generator = np.random.default_rng(3)
    codes, bounds = planted(generator, 10, 2000, 400, 300)
    topics = generator.integers(10, size=len(codes))
    counts = S.topic_counts(codes, topics, 2000, 10)
    began = time.process_time()
    S.gibbs_sweep(codes, bounds, topics, counts, counts.sum(axis=0), np.full(10, 0.1), 0.01, 2000, generator)
    return time.process_time() - began


def test_few_topics_are_drawn_from_all_their_weights(monkeypatch):
    drawn_in(monkeypatch, 64)
    assert min(drawn_in(monkeypatch, 64) for _ in range(3)) < 0.8 * min(drawn_in(monkeypatch, 0) for _ in range(3))


def test_many_topics_are_drawn_from_buckets(monkeypatch):
    monkeypatch.setattr(S, "DENSE_TOPICS", 0)
    test_a_sweep_keeps_counts(7, 5)
    test_draws_follow_the_conditional()


def test_a_stretch_does_not_cost_what_the_vocabulary_costs(monkeypatch):
    monkeypatch.setattr(S, "ENTRIES", 1 << 10)
    generator = np.random.default_rng(1)
    codes, bounds, n = generator.integers(2_000_000, size=30_000), np.arange(0, 30_001, 100), np.ones(30_000)
    weights = generator.random((2_000_000, 4))
    sums = np.zeros_like(weights)
    sums[codes] = 0  # so that its memory is there
    began = time.monotonic()
    gamma = S.variational(codes, n, bounds, weights, np.full(4, 0.1), sums)
    assert time.monotonic() - began < 2
    theta = np.repeat(np.exp(S.digamma(gamma) - S.digamma(gamma.sum(axis=1, keepdims=True))), 100, axis=0)
    shared = weights[codes] * theta
    wanted = np.zeros_like(sums)
    np.add.at(wanted, codes, shared / shared.sum(axis=1, keepdims=True))
    assert np.allclose(sums, wanted)


def test_settled_documents_are_left_out_together():
    """What is copied when documents settle is a few times the entries, however many steps it takes."""
    copied = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            found = super().__getitem__(key)
            if found.ndim == 2:
                copied.append(found.size)
            return found

    generator = np.random.default_rng(2)
    sizes = generator.integers(1, 300, size=100)
    weights, n = generator.random((6, sizes.sum())) ** 4, generator.integers(1, 5, size=sizes.sum()).astype(np.float64)
    found = S._settle(weights.view(Counted), n, sizes, np.full(6, 0.1))
    assert copied and sum(copied) <= 3 * weights.size
    ends = np.cumsum(sizes)
    alone = [S._settle(weights[:, end - size : end], n[end - size : end], np.array([size]), np.full(6, 0.1))[0] for size, end in zip(sizes, ends)]
    assert np.array_equal(found, np.stack(alone))


def test_sums_are_sent_in_pieces():
    sums = np.random.default_rng(1).random((500_000, 6))
    sums[::2] = 0
    tracemalloc.start()
    sent, last = 0, None
    for numbers, columns in L.sent_sums(sums, np.arange(6.0), 9):
        known = numbers >= 0
        assert np.array_equal(np.stack([c.to_numpy() for c in columns], axis=1)[known], np.rint(sums[numbers[known]] * L.UNITS))
        sent, last = sent + known.sum(), columns
    assert tracemalloc.get_traced_memory()[1] < sums.nbytes
    tracemalloc.stop()
    assert sent == 250_000 and [c[0].as_py() for c in last] == [k * L.UNITS for k in range(6)] and last[0][1].as_py() == 9 * L.UNITS


def test_expected_weights_are_worked_out_in_pieces(monkeypatch):
    matrix = np.random.default_rng(1).random((1000, 3)) + 0.1
    whole = np.exp(S.digamma(matrix) - S.digamma(matrix.sum(axis=0)))
    monkeypatch.setattr(L, "PIECE_TERMS", 7)
    assert np.array_equal(L.expected_weights(matrix), whole)


@pytest.mark.parametrize("optimizer", ["online", "em"])
def test_matrices_pass_in_pieces(spark, monkeypatch, optimizer):
    monkeypatch.setattr(E, "PASSED_NUMBERS", 3)
    monkeypatch.setattr(E, "TERMS_PER_TASK", 2)
    tokens = C.tokenise(spark.createDataFrame(list(enumerate(["a b b c e", "b c d", "a d d e"] * 3)), "id long, text string"))
    vectoriser = C.fit_vectoriser(tokens, 1, 1.0)
    model = E.TopicModel(vectoriser, E.train_lda(tokens, vectoriser, 2, optimizer, maxIter=2, seed=1))
    wanted = model.lda.topicsMatrix().toArray()
    assert np.array_equal(model._matrix, wanted) and np.array_equal(E._from_jvm(model.lda), wanted)
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    found = {(r.term_id, r.topic_id): (r.term, r.weight) for r in model.term_weights().collect()}
    assert len(found) == wanted.size
    for (term, topic), (word, weight) in found.items():
        assert word == vectoriser.vocabulary[term] and np.isclose(weight, wanted[term, topic] / wanted[:, topic].sum())


def test_topics_are_inferred_once(spark, monkeypatch):
    rows = spark.createDataFrame([(1, [0.25, 0.75], True), (2, [0.0, 0.0], False)], "id long, shares array<double>, has_terms boolean")
    monkeypatch.setattr(M, "vectors", lambda t, optimizer: rows.mapInArrow(lambda batches: batches, rows.schema))
    found = M.infer_topics(None, "gibbs")
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    assert sorted((r.id, r.has_terms, r.n_topics, r.is_share, r.adds_up) for r in found.collect()) == [(1, True, 2, True, True), (2, False, 2, True, True)]


def test_many_documents_are_drawn_in_few_groups(monkeypatch):
    """A step of a group costs the calls of a step, however many lanes it has."""
    drawn, real = [], S._draw_dense
    monkeypatch.setattr(S, "_draw_dense", lambda *given: drawn.append(len(given[7])) or real(*given))
    generator = np.random.default_rng(4)
    codes, bounds = planted(generator, 4, 200, 4000, 20)
    topics = generator.integers(4, size=len(codes))
    counts = S.topic_counts(codes, topics, 200, 4)
    S.gibbs_sweep(codes, bounds, topics, counts, counts.sum(axis=0), np.full(4, 0.1), 0.01, 200, generator)
    assert sum(drawn) == 4000 and len(drawn) <= 4
    assert (counts == S.topic_counts(codes, topics, 200, 4)).all()


def test_documents_are_settled_side_by_side(monkeypatch):
    settled, real = [], S._settle
    monkeypatch.setattr(S, "_settle", lambda *given: settled.append(len(given[2])) or real(*given))
    generator = np.random.default_rng(5)
    codes, bounds = generator.integers(500, size=200_000), np.arange(0, 200_001, 100)
    S.variational(codes, np.ones(200_000), bounds, generator.random((500, 3)), np.full(3, 0.1))
    assert settled == [2000]


def test_statistics_of_the_prior_do_not_depend_on_how_topics_are_counted():
    generator = np.random.default_rng(6)
    bounds, alpha = np.array([0, 3, 3, 40]), generator.random(7)
    topics = generator.integers(7, size=40)
    few = S.alpha_statistics(bounds, topics, alpha)
    sizes = np.diff(bounds)
    in_docs = S.topic_counts(np.repeat(np.arange(3), sizes), topics, 3, 7)
    above = (S.digamma(in_docs + alpha) - S.digamma(alpha)).sum(axis=0)
    assert np.allclose(few, np.append(above, (S.digamma(sizes + alpha.sum()) - S.digamma(alpha.sum())).sum()))
    wide = np.concatenate((alpha, generator.random(500)))
    assert np.allclose(S.alpha_statistics(bounds, topics, wide)[:7], above)

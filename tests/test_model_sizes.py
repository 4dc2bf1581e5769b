"""Models whose vocabulary grows: what passes through the driver, and what is left in the shared folder."""

import glob

import numpy as np
import pytest
from pyspark.ml.clustering import LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel

from newsloom.functions.staging import shared_dir
from newsloom.operators import features as C
from newsloom.operators import topic_model as E
from newsloom.operators.topic_tables import train_tables

TEXTS = ["a b b c", "b c d", "a d d", None, "zzz"] * 2


@pytest.fixture(scope="module")
def tokens(spark):
    return C.tokenise(spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string"))


def refused(*args, **kwargs):
    raise AssertionError("makes a call or a row on the driver for every term")


def test_terms_pass_in_one_call(tokens, monkeypatch):
    monkeypatch.setattr(CountVectorizerModel, "from_vocabulary", refused)
    assert C.fit_vectoriser(tokens, 2, 1.0).vocabulary == ["a", "b", "c", "d", "zzz"]


def test_term_counts(tokens, monkeypatch):
    monkeypatch.setattr(C, "COUNTED_TOKENS", 2)
    counted = {r.term: (r.df, r.tf) for r in C.term_counts(tokens).collect()}
    assert counted == {"a": (4, 4), "b": (4, 6), "c": (4, 4), "d": (4, 6), "zzz": (2, 2)}


def test_weights_and_shares_come_from_the_matrix(spark, tokens, monkeypatch):
    monkeypatch.setattr(LocalLDAModel, "describeTopics", refused)
    monkeypatch.setattr(LocalLDAModel, "transform", refused)
    vectoriser = C.fit_vectoriser(tokens, 3, 1.0)
    model = E.TopicModel(vectoriser, E.train_lda(tokens, vectoriser, 2, "online", maxIter=2, seed=1))
    weights = E.topic_words(model, spark).collect()
    assert len(weights) == 8 and {r.term for r in weights} == {"a", "b", "c", "d"}
    matrix = model.lda.topicsMatrix().toArray()
    for r in weights:
        assert r.term == vectoriser.vocabulary[r.term_id]
        assert np.isclose(r.weight, matrix[r.term_id, r.topic_id] / matrix[:, r.topic_id].sum())
    shares = {r.id: r.shares for r in E.infer_topics(model, tokens).collect()}
    assert len(shares) == 10 and shares[3] == [0, 0] and sum(shares[0]) == pytest.approx(1)


@pytest.mark.parametrize("kind", ["gibbs", "variational"])
def test_steps_leave_no_state_behind(spark, tokens, kind):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/newsloom/*/topic_state"))
    model = train_tables(tokens, C.build_vocabulary(tokens, 3, 1.0), 2, kind, iterations=3, seed=1)
    assert model.weights.count() == 4
    assert set(glob.glob(f"{folder}/newsloom/*/topic_state")) <= before

import time

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from newsloom.functions import lookup
from newsloom.operators import features as C

WORDS = ["the", "", "naïve", None, "x" * 70 + "a", "x" * 70 + "b", "x" * 70, "ab", "ba", "the", "zz", "日本"]


@pytest.mark.parametrize("hashed", [0, 1, 64])
def test_places_are_those_of_a_plain_search(hashed, monkeypatch):
    """With few hashed bytes most terms share a hash."""
    monkeypatch.setattr(lookup, "HASHED_BYTES", hashed)
    for terms in (["ba", "the", "", "x" * 70 + "b", "日本", "ab"], ["the", "a", "the"], []):
        index = lookup.TermIndex(pa.array(terms, pa.string()))
        words = pa.array(["skipped", *WORDS], pa.string()).slice(1)
        wanted = pc.fill_null(pc.index_in(words, value_set=pa.array(terms, pa.string())), -1).to_pylist()
        assert index.find(words).tolist() == [-1 if w is None else p for w, p in zip(WORDS, wanted, strict=True)]
    assert lookup.TermIndex(pa.array(["a"])).find(pa.array([], pa.string())).tolist() == []


def test_a_batch_does_not_cost_what_the_terms_cost():
    terms = pa.array([f"term{k}" for k in range(400_000)])
    index, words = lookup.TermIndex(terms), pa.array(["term7", "term399999", "none"])
    began = time.monotonic()
    for _ in range(200):
        assert index.find(words).tolist() == [7, 399_999, -1]
    assert time.monotonic() - began < 2


def test_lemmas_are_looked_up_by_an_index(spark, monkeypatch):
    made = []

    def counted(terms):
        made.append(len(terms))
        return lookup.TermIndex(terms)

    monkeypatch.setattr(C, "TermIndex", counted)
    tokens = spark.createDataFrame([(1, ["cats", None, "dog"]), (2, None), (3, [])], "id long, tokens array<string>")
    lemmas = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), ("cats", "catt")], "form string, lemma string")
    assert sorted((r.id, r.tokens) for r in C.lemmatise(tokens, lemmas).collect()) == [(1, ["cat", None, "dog"]), (2, None), (3, [])]
    assert made == [2]

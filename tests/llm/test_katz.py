import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from newsloom.llm import katz

SPACES = " \t\n\v\f\r"


def tokens_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return lowered.encode().split() + [None]


def is_held_out(doc_id):
    return doc_id is None or crc32(str(doc_id).encode()) % 10 == 0


class Brute:
    """The same model from plain counters; ``probability`` recurses to lower orders."""

    def __init__(self, docs, order):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for tokens in docs:
            padded = ["<s>"] * (order - 1) + tokens
            for i in range(order - 1, len(padded)):
                for n in range(1, order + 1):
                    self.counts[n][tuple(padded[i - n + 1 : i + 1])] += 1
        self.factors = [None]
        for n in range(1, order + 1):
            of = Counter(min(c, katz.DISCOUNTED + 2) for c in self.counts[n].values())
            self.factors.append(katz.discounts(np.array([of.get(r, 0) for r in range(katz.DISCOUNTED + 3)], dtype=float)))
        self.words = [w for (w,) in self.counts[1]]
        self.followers = [None] + [{} for _ in range(order)]
        for n in range(1, order + 1):
            for gram in self.counts[n]:
                self.followers[n].setdefault(gram[:-1], []).append(gram[-1])

    def probability(self, context, word):
        n = len(context) + 1
        if n == 0 or not self.followers[n].get(context):
            return self.lower(context, word)
        seen = {w: self.counts[n][(*context, w)] for w in self.followers[n][context]}
        total = sum(seen.values())
        if all(c > katz.DISCOUNTED for c in seen.values()):
            total += 1
        kept = {w: self.factors[n][min(c, katz.DISCOUNTED + 1)] * c / total for w, c in seen.items()}
        if word in kept:
            return kept[word]
        rest = 1 - sum(self.lower(context, w) for w in kept)
        return (1 - sum(kept.values())) / rest * self.lower(context, word)

    def lower(self, context, word):
        if not context:
            return 1 / (len(self.words) + 1)
        return self.probability(context[1:], word)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_brute_force(spark, order):
    rng = np.random.default_rng(1)
    words = [f"w{int(i)}" for i in rng.zipf(1.4, size=6000) if i < 300]
    docs = [(i, " ".join(words[i * 37 : i * 37 + 30])) for i in range(100)] + [(100, None), (101, "Unseen WORDS here")]
    model = Brute([tokens_of(t) for i, t in docs if not is_held_out(i)], order)
    n = sum(model.counts[1].values())
    found = {r["doc_id"]: r for r in katz.score_documents(rows_of(spark, docs), order).collect()}
    assert len(found) == len(docs)
    for i, text in docs:
        tokens = tokens_of(text)
        padded = ["<s>"] * (order - 1) + tokens
        score = sum(math.log10(model.probability(tuple(padded[k : k + order - 1]), t)) for k, t in enumerate(tokens))
        base = sum(math.log10((model.counts[1][(t,)] + 0.1) / (n + 0.1 * (len(model.words) + 1))) for t in tokens)
        row = found[i]
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (is_held_out(i), len(tokens), n)
        assert row["n_known"] == sum(model.counts[1][(t,)] > 0 for t in tokens)
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        assert row["score"] == pytest.approx(score, rel=1e-7)


def test_contexts_sum_to_one():
    docs = [[b"a", b"b", b"a", None], [b"a", b"c", None], [b"b"] * 40 + [None]]
    model = Brute(docs, 2)
    for context in [("<s>",), (b"a",), (b"b",), (b"c",), ()]:
        assert sum(model.probability(context, w) for w in [*model.words, "unknown"]) == pytest.approx(1)


def test_better_than_base_on_held_out(documents):
    rows = [r for r in katz.score_documents(documents).collect() if r["held_out"]]
    assert rows and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_odd_rows(odd_documents, no_documents):
    rows = katz.score_documents(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)] == [1, 1, 1]
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert katz.score_documents(no_documents).count() == 0


def test_nothing_to_train_on(spark):
    held_out = [i for i in range(200) if is_held_out(i)][:3]
    rows = katz.score_documents(rows_of(spark, [(i, "a b") for i in held_out])).collect()
    assert [(r["train_tokens"], r["n_known"], r["score"]) for r in rows] == [(0, 0, 0.0)] * 3

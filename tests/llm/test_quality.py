import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from newsloom.llm import quality
from newsloom.llm.text import pieces


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def plain_features(text):
    """The features of one text, one word at a time."""
    kinds = {**{c: "a" for c in range(97, 123)}, **{c: "A" for c in range(65, 91)}, **{c: "0" for c in range(48, 58)}}
    out, last, last_shape = [], None, None
    for word in text.encode().split():
        shape = []
        for byte in word:
            kind = kinds.get(byte, "u" if byte > 127 else byte)
            if not shape or shape[-1] != kind:
                shape.append(kind)
        shape = "again" if word.lower() == last else tuple(shape)
        out += [("word", word.lower()), ("shape", shape), ("pair", last_shape, shape)]
        last, last_shape = word.lower(), shape
    return out


def test_features_are_those_of_plain_code():
    texts = ["The cat sat. The cat sat", "A!! B!! b!! 12,5 é", "", "x x x", "Ab"]
    numbers, rows = quality.features(pa.array([t.encode() for t in texts]))
    wanted = [f for t in texts for f in plain_features(t)]
    n = len(wanted) // 3
    named = {}
    for family in range(3):
        for k in range(n):
            assert named.setdefault(wanted[3 * k + family], numbers[family * n + k]) == numbers[family * n + k]
    assert len(set(named.values())) == len(named)
    assert np.bincount(rows, minlength=5).tolist() == [3 * len(t.split()) for t in texts]


def test_weights_equal_brute_force(spark):
    docs = [(i, t) for i, t in enumerate(["good text here", "BAD!! BAD!! STUFF!!", "more good text", "Junk### of%%% it", None])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = labels_of(spark, [(0, 1, 0), (1, 0, 0), (2, 1, None), (3, 1, 1)])
    out = {r["doc_id"]: r for r in quality.resample(frame, labels, k=3).collect()}
    for doc_id, text in docs:
        weight = 0.0
        for family, size in zip(("word", "shape", "pair"), quality.FAMILIES, strict=True):
            every = [f for _, t in docs for f in plain_features(t or "") if f[0] == family]
            target = [f for i, t in docs if i in (0, 2) for f in plain_features(t or "") if f[0] == family]
            for feature in (f for f in plain_features(text or "") if f[0] == family):
                raw = (every.count(feature) + 1) / (len(every) + size)
                own = (target.count(feature) + quality.PRIOR * size * raw) / (len(target) + quality.PRIOR * size)
                weight += math.log(own / raw)
        assert out[doc_id]["log_weight"] == pytest.approx(weight, abs=1e-9)
        assert out[doc_id]["key"] == pytest.approx(weight + quality.gumbel(np.array([doc_id]), quality.SEED)[0], abs=1e-9)
    keys = sorted((r["key"] for r in out.values()), reverse=True)
    assert {i for i, r in out.items() if r["kept"]} == {i for i, r in out.items() if r["key"] >= keys[2]}


def test_gumbel_noise_samples_in_proportion():
    weights = np.array([1.0, 2.0, 5.0])
    first = np.argmax(np.log(weights) + quality.gumbel(np.arange(60_000), 3).reshape(-1, 3), axis=1)
    assert np.bincount(first) / len(first) == pytest.approx(weights / weights.sum(), abs=0.02)


def test_held_out_accuracy(spark):
    """Labels the model has not seen: bad documents go, good ones stay."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = quality.resample(docs, labels.where("doc_id % 2 = 0"))
    seen = out.join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in seen}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.99
    assert n.get((0, True), 0) / (n.get((0, True), 0) + n[0, False]) < 0.01


@pytest.mark.parametrize("k", [0, 1, 2, 5, 6, 7, 100])
def test_kth_largest(spark, k):
    values = [3.0, 1.0, 2.0, 2.0, -5.5, 1e-12]
    least = quality.kth_largest(spark.createDataFrame([(v,) for v in values], "v double"), "v", k)
    assert least == (math.inf if k == 0 else sorted(values, reverse=True)[min(k, 6) - 1])


def test_odd_rows(spark, odd_documents, no_documents):
    labels = labels_of(spark, [(1, 1, 0), (1, 1, 0), (None, 1, 0), (99, 1, None), (5, None, None)])
    out = quality.resample(odd_documents, labels)
    assert out.count() == odd_documents.count()
    assert {r["log_weight"] for r in out.collect() if r["doc_id"] in (2, 3, 4)} == {0.0}
    kept = quality.select(odd_documents, labels)
    assert kept.columns == odd_documents.columns and kept.count() == out.where("kept").count()
    assert quality.resample(no_documents, labels).count() == 0
    assert quality.select(odd_documents, labels.limit(0)).count() == odd_documents.count()


def test_features_need_little_memory():
    texts = [" ".join(f"{w}{k % 97}" for k in range(800) for w in ("Alpha", "beta,", "the")) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts])], names=["text"])
    ratios = np.arange(quality.STARTS[-1]) * 1e-3
    quality._log_weights(batch.column(0).slice(0, 1), ratios)
    tracemalloc.start()
    weights = [quality._log_weights(p.column(0), ratios) for p in pieces([batch], 0, quality.PIECE_BYTES)]
    assert tracemalloc.get_traced_memory()[1] < 70 << 20
    tracemalloc.stop()
    assert np.array_equal(np.concatenate(weights), np.concatenate([quality._log_weights(batch.column(0).slice(k, 1), ratios) for k in range(600)]))

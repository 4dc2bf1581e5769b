import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from newsloom.llm import set_join
from newsloom.llm.graph import connected_components


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def brute(rows):
    sets = []
    for _, text in rows:
        words = lowered(text)
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted((doc_id if doc_id is not None else -1, len(s), least.get(top(i), -1)) for i, ((doc_id, _), s) in enumerate(zip(rows, sets)))


def found(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = set_join.group_documents(frame).collect()
    none = lambda x: -1 if x is None else x
    return sorted((none(r["doc_id"]), r["n_shingles"], none(r["component_id"])) for r in out)


def planted(seed, n_groups=12, copies=9):
    """Groups of near copies with more and more edits, chains, contained texts and shared passages."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = list(rng.choice(vocabulary, 60))
    rows, number = [], 0
    for g in range(n_groups):
        text = list(rng.choice(vocabulary, int(rng.integers(5, 160))))
        if g % 3 == 0:
            text += passage
        for k in range(copies):
            words = list(text)
            for _ in range(int(rng.integers(0, 1 + len(words) // 25))):
                words[int(rng.integers(len(words)))] = str(rng.choice(vocabulary))
            if g % 4 == 1:
                text = words
            if g % 4 == 2:
                words = words[: max(1, len(words) * int(rng.integers(70, 100)) // 100)]
            rows.append((number, " ".join(words)))
            number += 1
    return rows + [(number + 1, rows[0][1].upper()), (number + 2, ""), (number + 3, None), (number + 4, "a b"), (number + 5, "A  b"), (None, "q r s"), (None, None)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = planted(seed)
    assert found(spark, rows) == brute(rows)


def test_answers_from_leaders(spark, monkeypatch):
    """The order of shingles only steers the work: with no counts the result is the same."""
    monkeypatch.setattr(set_join, "MIN_FREQUENT", 10**9)
    rows = planted(4)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("turns", [0, 1])
def test_links_beyond_leaders(spark, monkeypatch, turns):
    """What leaders do not connect is found between groups."""
    monkeypatch.setattr(set_join, "TURNS", turns)
    rows = planted(5)
    assert found(spark, rows) == brute(rows)


def test_on_documents(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(odd_documents, no_documents):
    out = set_join.group_documents(odd_documents)
    assert out.count() == odd_documents.count()
    by_id = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    assert by_id[2] == (0, 2) and by_id[3] == (0, 3) and by_id[8] == (4, 1) and by_id[6] == (1, 6)
    assert set_join.group_documents(no_documents).count() == 0


def test_keep_one_per_group(odd_documents, no_documents):
    kept = set_join.keep_one_per_group(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect())
    assert ids == [-1, 1, 2, 3, 4, 5, 6, 7]  # the one without id has no text
    assert set_join.keep_one_per_group(no_documents).count() == 0


def test_one_is_kept_per_group_whatever_the_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words, f"end{i}"]) for i in range(3)]
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(None, text) for text in near] + [(7, other), (7, " ".join(f"u{i}" for i in range(60)))]
    kept = [r["doc_id"] for r in set_join.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == [7, 7, None]


def test_the_row_kept_is_the_smallest_and_columns_stay(spark):
    words = " ".join(f"w{i}" for i in range(20))
    rows = [(1, words.upper(), "x", "s1", "b"), (1, words, "y", "s2", "c"), (1, words, "y", "s2", "a"), (2, words + " w20", "z", None, "d"), (3, "other words here", "q", "s3", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _set string, _row string")
    for order in (docs, docs.orderBy(docs["_row"].desc()).repartition(3)):
        kept = set_join.keep_one_per_group(order)
        assert kept.columns == docs.columns
        # Upper case comes before lower case.
        assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[4]]
    kept = set_join.keep_one_per_group(docs.where("_row <> 'b'"))
    assert sorted(tuple(r) for r in kept.collect()) == [rows[2], rows[4]]


def test_signatures_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(1)
    base = rng.integers(1 << 63, size=400, dtype=np.uint64)
    sets = [np.unique(rng.choice(base, size=n, replace=False)) for n in (0, 1, 5, 50, 300, 390)]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    found = np.array(set_join._signatures(np.concatenate(sets), bounds)).T
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            bits = int(np.bitwise_count((found[i] ^ found[j]).view(np.uint64)).sum())
            assert bits <= len(np.setxor1d(a, b))
            assert (len(np.setxor1d(a, b)) - bits) % 2 == 0
    assert not found[0].any()


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100), (201, 200), (200, 202), (None, 3)]
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(61)} | {100: 100, 200: 200, 201: 200, 202: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("step", ["weights", "postings", "sets"])
def test_a_task_holds_the_sets_of_few_texts(monkeypatch, step):
    """However many texts a batch has, hashes, shingles and prefixes of some of them are held at once."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{i}" for i in rng.integers(5000, size=400).tolist()) for _ in range(6000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([x.encode() for x in texts])], names=["doc_id", "text"])
    tasks = []
    docs = SimpleNamespace(sparkSession=SimpleNamespace(conf=SimpleNamespace(get=lambda name: "6")))

    def kept(function, schema):
        tasks.append(function)
        raise StopIteration

    monkeypatch.setattr(set_join, "_texts", lambda docs: SimpleNamespace(mapInArrow=kept))
    weights = SimpleNamespace(value=np.ones(1 << set_join.TABLE_BITS, dtype=np.uint8))
    with pytest.raises(StopIteration):
        if step == "weights":
            set_join.shingle_weights(docs)
        elif step == "postings":
            set_join._postings(docs, weights, 6, 75, 5)
        else:
            set_join._document_sets(docs, 5)
    list(tasks[0](iter([batch.slice(0, 10)])))
    tracemalloc.start()
    rows = sum(part.num_rows for part in tasks[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and peak < 5 * batch.nbytes, peak / batch.nbytes


def test_sets_are_made_of_small_batches(spark, monkeypatch):
    """Whole texts reach Python some MB at a time; the session has its own bound back afterwards."""
    bounds = []
    own = set_join.stage

    def seen(frame, name):
        bounds.append((name, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)))
        return own(frame, name)

    monkeypatch.setattr(set_join, "stage", seen)
    assert set_join.keep_one_per_group(spark.createDataFrame(planted(6, 2, 3), "doc_id long, text string")).count()
    found = {name for name, bound in bounds if bound is not None and int(bound) <= 4 << 20}
    assert {"document_sets", "shared", "sets", "named"} <= found
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None


def test_rows_beside_texts_without_words_stay(spark):
    """Set ids have 64 bits also in a batch with texts that have none."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(9))) for i in range(30)] + [(30, ""), (31, None)]
    kept = set_join.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(32))

import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from newsloom.functions.sizing import is_small
from newsloom.functions.staging import free_shuffles, path_exists, stage
from newsloom.operators import features as C
from newsloom.operators import search_index as D
from newsloom.operators import topic_model as E
from newsloom.plans import ArticleCorpus, SearchIndex


def token_table(spark, documents):
    return spark.createDataFrame(list(documents.items()), "id long, tokens array<string>")


def as_dict(tokens):
    return {r.id: list(r.tokens) for r in tokens.collect()}


def random_documents(seed, n=60, words=8, longest=30):
    rng = random.Random(seed)
    vocabulary = [chr(97 + i) * (i % 3 + 1) for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return {i: rng.choices(vocabulary, weights, k=rng.randint(0, longest)) for i in range(n)}


def greedy(words, phrases):
    out, i = [], 0
    while i < len(words):
        if tuple(words[i : i + 2]) in phrases:
            out.append("_".join(words[i : i + 2]))
            i += 2
        else:
            out.append(words[i])
            i += 1
    return out


@pytest.mark.parametrize("merge", [C._merge_by_lookup, C._merge_by_join])
def test_merge_left_to_right(spark, merge):
    # 7 ends and 8 begins with the halves of a phrase.
    documents = {1: ["a", "b", "c"], 2: ["b", "c", "a", "b"], 3: [], 4: ["a"], 5: ["x", "y"], 6: [], 7: ["a"], 8: ["b", "a"]}
    tokens = token_table(spark, documents).coalesce(1)
    phrases = spark.createDataFrame([("a", "b"), ("b", "c")], "w1 string, w2 string")
    assert as_dict(merge(tokens, phrases)) == {
        1: ["a_b", "c"],
        2: ["b_c", "a_b"],
        3: [],
        4: ["a"],
        5: ["x", "y"],
        6: [],
        7: ["a"],
        8: ["b", "a"],
    }


def test_merge_keeps_missing_lists(spark):
    tokens = spark.createDataFrame([(1, None), (2, ["a", "b"]), (3, None)], "id long, tokens array<string>").coalesce(1)
    phrases = spark.createDataFrame([("a", "b")], "w1 string, w2 string")
    rows = C._merge_by_lookup(tokens, phrases).collect()
    assert {r.id: r.tokens for r in rows} == {1: None, 2: ["a_b"], 3: None}
    assert C._merge_by_lookup(tokens, phrases.where("w1 = 'z'")).count() == 3


def test_merge_does_not_depend_on_size(spark, monkeypatch):
    """Repeated ids and other columns: the size of the phrase set changes nothing."""
    rows = [(1, ["a", "b", "c"], "x"), (1, ["x", "a", "b"], "y"), (2, None, None), (None, ["a", "b"], "z")]
    tokens = spark.createDataFrame(rows, "id long, tokens array<string>, tag string")
    phrases = spark.createDataFrame([("a", "b")], "w1 string, w2 string")
    found = []
    for small in (True, False):
        monkeypatch.setattr(C, "is_small", lambda *_, small=small: small)
        merged = C.apply_phrases(tokens, phrases)
        assert merged.columns == tokens.columns
        found.append(sorted(map(str, merged.collect())))
    assert found[0] == found[1] == sorted(
        map(str, spark.createDataFrame([(1, ["a_b", "c"], "x"), (1, ["x", "a_b"], "y"), (2, None, None), (None, ["a_b"], "z")], tokens.schema).collect())
    )


def test_streams_need_a_phrase_set_that_fits(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(1, "a b")], "id long, text string").write.parquet(str(tmp_path / "in"))
    stream = C.tokenise(spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in")))
    monkeypatch.setattr(C, "is_small", lambda *_: False)
    with pytest.raises(ValueError, match="too large"):
        C.apply_phrases(stream, spark.createDataFrame([("a", "b")], "w1 string, w2 string"))


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("merge", [C._merge_by_lookup, C._merge_by_join])
def test_merge_equals_brute_force(spark, merge, seed):
    documents = random_documents(seed, n=300)
    phrases = {("a", "a"), ("a", "bb"), ("bb", "ccc"), ("ccc", "a"), ("d", "d")}
    table = spark.createDataFrame(sorted(phrases), "w1 string, w2 string")
    wanted = {i: greedy(words, phrases) for i, words in documents.items()}
    assert as_dict(merge(token_table(spark, documents), table)) == wanted


@pytest.mark.parametrize("min_count, threshold", [(5, 1.0), (0, 0.0), (2, -1.0)])
def test_phrases_equal_brute_force(spark, min_count, threshold):
    documents = random_documents(5)
    single, pairs = Counter(), Counter()
    for words in documents.values():
        single.update(words)
        pairs.update(zip(words, words[1:]))
    size = len(single) + len(pairs)
    wanted = {
        pair: (n, (n - min_count) / single[pair[0]] / single[pair[1]] * size)
        for pair, n in pairs.items()
        if (n - min_count) / single[pair[0]] / single[pair[1]] * size > threshold
    }
    rows = C.learn_phrases(token_table(spark, documents), min_count, threshold).collect()
    assert {(r.w1, r.w2): (r.n, pytest.approx(r.score)) for r in rows} == wanted


def test_vocabulary_equals_brute_force(spark):
    documents = random_documents(8, words=12)
    df, tf = Counter(), Counter()
    for words in documents.values():
        df.update(set(words))
        tf.update(words)
    kept = {t: (df[t], tf[t]) for t in df if 5 <= df[t] <= 0.6 * len(documents)}
    tokens = token_table(spark, documents)
    found = {r.term: (r.df, r.tf) for r in C.build_vocabulary(tokens).collect()}
    assert found == kept and kept
    assert set(C.fit_vectoriser(tokens).vocabulary) == set(kept)


def test_vocabulary_has_no_hidden_limit(spark, monkeypatch):
    documents = {i: ["often", f"w{i % 7}"] for i in range(70)}
    tokens = token_table(spark, documents)
    assert C.build_vocabulary(tokens, 1, 1.0).count() == 8
    monkeypatch.setattr(C, "MAX_MODEL_TERMS", 7)
    with pytest.raises(ValueError, match="8 terms"):
        C.fit_vectoriser(tokens, 1, 1.0)


def test_counted_terms(spark):
    documents = random_documents(10) | {900: [], 901: ["zzz"], 902: ["a"] * 5}
    vocabulary = spark.createDataFrame([("a",), ("bb",), ("never",)], "term string")
    wanted = {(i, t, n) for i, words in documents.items() for t, n in Counter(words).items() if t in ("a", "bb")}
    assert {tuple(r) for r in C.count_terms(token_table(spark, documents), vocabulary).collect()} == wanted


def test_vocabulary_cap_ranks_by_documents(spark):
    documents = {i: ["often"] * 1 + (["burst"] * 50 if i < 5 else []) + (["mid"] if i < 8 else []) for i in range(10)}
    tokens = token_table(spark, documents)
    options = {"min_docs": 1, "max_doc_share": 1.0, "max_terms": 2}
    assert [r.term for r in C.build_vocabulary(tokens, **options).collect()] == ["often", "mid"]
    # By occurrences 'burst' would be first.
    assert C.fit_vectoriser(tokens, **options).vocabulary == ["often", "mid"]


def test_bags_of_words(spark):
    documents = random_documents(9)
    corpus = ArticleCorpus(spark.createDataFrame([(i, " ".join(w)) for i, w in documents.items()], "id long, text string"))
    known = {r.term: r.term_id for r in corpus.vocabulary().collect()}
    wanted = {
        (i, known[t], n) for i, words in documents.items() for t, n in Counter(words).items() if t in known
    }
    assert {tuple(r) for r in C.flat_bags_of_words(corpus.bags_of_words()).collect()} == wanted
    assert {tuple(r) for r in corpus.bag_of([3, 4]).collect()} == {w for w in wanted if w[0] in (3, 4)}


def test_lemmas(spark):
    tokens = token_table(spark, {1: ["cats", "sat", "cats"], 2: [], 3: ["dogs"]})
    lemmas = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "form string, lemma string")
    assert as_dict(C.lemmatise(tokens, lemmas)) == {1: ["cat", "sat", "cat"], 2: [], 3: ["dog"]}


def test_large_lemma_tables_give_the_same_tokens(spark, monkeypatch):
    rows = [(1, ["cats", None, "sat", "cats"], "x"), (1, ["dogs"], "y"), (2, [], "z"), (3, None, "z"), (None, ["sat"], "z")]
    tokens = spark.createDataFrame(rows, "id long, tokens array<string>, other string")
    lemmas = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), ("dogs", "zzz"), (None, "q")], "form string, lemma string")
    small = sorted(map(tuple, C.lemmatise(tokens, lemmas).collect()), key=str)
    monkeypatch.setattr(is_small, "__defaults__", (1, 1 << 20))
    large = C.lemmatise(tokens, lemmas)
    assert large.columns == tokens.columns
    assert sorted(map(tuple, large.collect()), key=str) == small
    assert (1, ["cat", None, "sat", "cat"], "x") in small and (1, ["dog"], "y") in small and len(small) == 5
    E.TopicModel(None, None, lemmas=lemmas)


def test_corpus_tokens_with_phrases(spark, tmp_path):
    texts = spark.createDataFrame([(i, "new york is new york" + " x" * i) for i in range(20)], "id long, text string")
    corpus = ArticleCorpus(texts, tokens_path=str(tmp_path / "tokens"))
    corpus.learn_phrases(min_count=5, threshold=0.1)
    assert ("new", "york") in {(r.w1, r.w2) for r in corpus.phrases.collect()}
    assert as_dict(corpus.tokens(1))[0][0] == "new_york"
    assert 3 in corpus and 99 not in corpus


DOCUMENTS = {1: "The cat. the CAT", 2: "A dog", 3: "the dog!", 4: ""}


def documents_table(spark, documents=DOCUMENTS):
    return spark.createDataFrame(list(documents.items()), "id long, text string")


def ids(postings, term):
    return sorted(r.id for r in D.query_index(postings, term).collect())


def test_index_keeps_case_and_punctuation(spark):
    postings = D.index_documents(documents_table(spark))
    assert ids(postings, "the") == [1, 3] and ids(postings, "The") == [1]
    assert ids(postings, "!") == [3] and ids(postings, "cow") == []
    assert postings.count() == postings.distinct().count()


def test_index_with_second_form(spark):
    lower = D.index_documents(documents_table(spark), preprocess_tokens=True)
    assert ids(lower, "cat") == [1] and ids(lower, "CAT") == [1] and ids(lower, "a") == [2]
    first = D.index_documents(
        documents_table(spark), True, lambda tokens: F.transform(tokens, lambda t: F.concat(F.lit("#"), t))
    )
    assert ids(first, "#dog") == [2, 3] and ids(first, "dog") == [2, 3]


def test_reindexing_replaces(spark):
    batches = spark.createDataFrame([(1, 0, "old"), (1, 1, "new"), (2, 0, "other")], "id long, batch int, text string")
    latest = D.latest_documents(batches)
    assert {(r.id, r.text) for r in latest.collect()} == {(1, "new"), (2, "other")}
    postings = D.add_to_index(D.index_documents(documents_table(spark)), latest)
    assert ids(postings, "cat") == [] and ids(postings, "new") == [1] and ids(postings, "the") == [3]


def test_search_index_by_batches(spark, tmp_path):
    index = SearchIndex(spark, preprocess_tokens=True)
    index.index(documents_table(spark))
    index.index(documents_table(spark, {2: "A COW", 5: "the end"}))
    assert sorted(r.id for r in index.query("cow").collect()) == [2]
    assert sorted(r.id for r in index.query("dog").collect()) == [3]
    index.save(str(tmp_path / "index"))
    loaded = SearchIndex.load(spark, str(tmp_path / "index"))
    assert sorted(r.id for r in loaded.query("the").collect()) == [1, 3, 5]
    assert {r.id: r.text for r in loaded.documents.collect()} == DOCUMENTS | {2: "A COW", 5: "the end"}


def test_hot_token_is_split_into_blocks(spark):
    """One token in every document, also with negative ids."""
    documents = spark.range(-50, 1000).select("id", F.lit("hot").alias("text"))
    blocks = D.posting_blocks(D.index_documents(documents), block_ids=100).collect()
    assert max(len(b.ids) for b in blocks) == 100 and len(blocks) == 11
    found = sorted(i for b in blocks for i in b.ids)
    assert found == list(range(-50, 1000))
    assert all(b.block == i // 100 for b in blocks for i in b.ids)
    by_block = defaultdict(int)
    for b in blocks:
        by_block[b.block] += b.n_docs
    assert sum(by_block.values()) == 1050


def test_batches_are_appended(spark):
    """A second batch leaves the files of the first alone; compacting keeps what is read."""
    from pathlib import Path

    index = SearchIndex(spark)
    index.index(spark.createDataFrame([(i, f"word{i} common") for i in range(50)], "id long, text string"))
    before = {p: p.stat().st_mtime_ns for p in Path(index.path).rglob("*.parquet")}
    index.index(spark.createDataFrame([(3, "new common"), (77, "other")], "id long, text string"))
    after = {p: p.stat().st_mtime_ns for p in Path(index.path).rglob("*.parquet")}
    assert before.items() <= after.items()
    assert spark.read.parquet(f"{index.path}/postings").where("batch = 1").count() == 3
    found = lambda: ({r.id for r in index.query("common").collect()}, index.query("word3").count(), index.documents.count())
    assert found() == (set(range(50)), 0, 51)
    index.compact()
    assert found() == (set(range(50)), 0, 51)
    assert SearchIndex(spark).query("x").count() == 0


def all_of(index):
    """The index by brute force: the last text of each id."""
    return {r.id: r.text for r in index.documents.collect()}, sorted((r.token, r.id) for r in index.postings.collect())


def brute_index(batches):
    texts = {}
    for batch in batches:
        texts |= batch
    return texts, sorted({(token, i) for i, text in texts.items() for token in text.split()})


def test_an_index_outlives_its_session(spark, tmp_path):
    path = str(tmp_path / "index")
    batches = [{1: "a b", 2: "b c", 3: "c"}, {2: "x", 4: "a"}, {5: "b", 2: "y a"}]
    for n, batch in enumerate(batches):
        # Each batch is written by an object that knows nothing but the folder, the last one by a new session.
        session = spark.newSession() if n == 2 else spark
        SearchIndex(session, path=path).index(documents_table(session, batch))
        assert all_of(SearchIndex(spark.newSession(), path=path)) == brute_index(batches[: n + 1])
    index = SearchIndex(spark, path=path)
    assert index.num_batches == 3
    assert sorted(r.id for r in index.query("b").collect()) == [1, 5]
    index.compact()
    reopened = SearchIndex(spark, path=path)
    assert reopened.num_batches == 1 and all_of(reopened) == brute_index(batches)
    # Nothing that was replaced is read any more: one batch, and no list of replaced rows.
    plan = reopened.query("b")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1
    with pytest.raises(ValueError, match="preprocess_tokens"):
        SearchIndex(spark, preprocess_tokens=True, path=path)


def test_batches_of_one_size_are_merged(spark, tmp_path, monkeypatch):
    from newsloom.plans import search

    monkeypatch.setattr(search, "FAN_IN", 3)
    path, batches, rng = str(tmp_path / "index"), [], random.Random(3)
    for n in range(10):
        batches.append({rng.randrange(12): f"w{n} t{rng.randrange(4)}"})
        index = SearchIndex(spark, path=path)
        index.index(documents_table(spark, batches[-1]))
        assert index.num_batches <= 5
    assert all_of(SearchIndex(spark, path=path)) == brute_index(batches)


def test_a_batch_that_breaks_off_is_not_there(spark, tmp_path):
    path = str(tmp_path / "index")
    index = SearchIndex(spark, path=path)
    index.index(documents_table(spark, {1: "a"}))
    # A writer that died after its documents and postings, and one that died while writing a manifest.
    documents_table(spark, {1: "lost", 2: "lost"}).write.parquet(f"{path}/documents/batch=1")
    spark.createDataFrame([("lost", 1)], "token string, id long").write.parquet(f"{path}/postings/batch=1")
    (tmp_path / "index" / "manifest" / "version=2").mkdir()
    reopened = SearchIndex(spark, path=path)
    assert all_of(reopened) == brute_index([{1: "a"}])
    (tmp_path / "index" / "manifest" / "version=2").rmdir()
    reopened.index(documents_table(spark, {3: "c"}))
    assert all_of(SearchIndex(spark, path=path)) == brute_index([{1: "a"}, {3: "c"}])
    # A writer with an old view of the index is refused and changes nothing.
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        index.index(documents_table(spark, {9: "late"}))
    assert all_of(SearchIndex(spark, path=path)) == brute_index([{1: "a"}, {3: "c"}])


def test_empty_index(spark, tmp_path):
    index = SearchIndex(spark, path=str(tmp_path / "index"))
    index.compact()
    index.index(documents_table(spark).limit(0))
    assert all_of(SearchIndex(spark, path=str(tmp_path / "index"))) == ({}, [])


def test_phrases_are_learned_in_passes(spark, monkeypatch):
    """Pairs of all passes count as one, and only phrases stay stored."""
    made, real = [], C.stage
    rows = [(i, ["new", "york", "a" * (i % 3 + 1), "old", "town", None, "b" * (i % 7 + 1)]) for i in range(60)] + [(61, []), (62, None), (63, ["old"])]
    tokens = spark.createDataFrame(rows, "id long, tokens array<string>")
    whole = sorted(map(tuple, C.learn_phrases(tokens, 5, 0.2).collect()))
    monkeypatch.setattr(C, "PASS_TOKENS", 50)
    monkeypatch.setattr(C, "stage", lambda df, name: made.append((name, real(df, name))) or made[-1][1])
    found = C.learn_phrases(tokens, 5, 0.2)
    assert whole == sorted(map(tuple, found.collect())) and {("new", "york"), ("old", "town")} <= {row[:2] for row in whole}
    assert [name for name, _ in made].count("pair_counts") == C.PAIR_PASSES
    stored = {name for name, table in made if any(path_exists(spark, path) for path in _folders(table))}
    assert stored == {"phrases"}


def _folders(table):
    return {path.rsplit("/", 1)[0] for path in table.inputFiles()}


def test_shuffle_files_are_deleted(spark):
    """Also those of the last query, while other tables may keep theirs."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {name for k in range(blocks.getAllBlocks().size()) if (name := blocks.getAllBlocks().apply(k).name()).startswith("shuffle_")}

    free_shuffles(spark)
    before = shuffles()
    stage(spark.range(1000).select((F.col("id") % 7).alias("k")).groupBy("k").count(), "counts")
    assert shuffles() - before
    free_shuffles(spark)
    for _ in range(50):
        if not shuffles() - before:
            return
        time.sleep(0.1)
    raise AssertionError("shuffle files are left")

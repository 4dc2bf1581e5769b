import random

import pytest

from newsloom.operators import features as C
from newsloom.operators import lemma_rules as R
from newsloom.operators import topic_model as E
from newsloom.operators import topic_tables as T
from newsloom.plans import ArticleCorpus
from newsloom.streaming import read_article_stream, tag_in_batches, tag_stream, write_tags

VOWELS = "aeiou"


def inflections(stem):
    """Regular English verbs: the third person, the past and the participle."""
    if stem.endswith("e"):
        return [stem + "s", stem + "d", stem[:-1] + "ing"]
    if stem.endswith("y") and stem[-2] not in VOWELS:
        return [stem[:-1] + "ies", stem[:-1] + "ied", stem + "ing"]
    third = stem + ("es" if stem.endswith(("s", "x", "z", "ch", "sh")) else "s")
    return [third, stem + "ed", stem + "ing"]


def stems(n, seed=0):
    rng = random.Random(seed)
    ends = ["ate", "ise", "ify", "ry", "ark", "ench", "ish", "ill", "ax", "ount", "ay", "ess", "lect", "pute", "mit"]
    onset = ["b", "cr", "d", "fl", "gr", "k", "l", "m", "pr", "st", "tr", "v", "w", "sp", "gl"]
    return sorted({rng.choice(onset) + rng.choice(VOWELS) + rng.choice("lmnrt") + rng.choice(ends) for _ in range(3 * n)})[:n]


def table(spark, rows):
    return spark.createDataFrame(rows, "form string, lemma string")


def plain_rules(pairs, max_suffix=R.MAX_SUFFIX, min_count=R.MIN_COUNT, min_share=R.MIN_SHARE):
    counts = {}
    for form, lemma in set(pairs):
        kept = max(n for n in range(min(len(form), len(lemma)) + 1) if form[:n] == lemma[:n])
        cut, addition = len(form) - kept, lemma[kept:]
        for n in range(cut, max(cut, min(len(form), max_suffix)) + 1):
            own = counts.setdefault(form[len(form) - n :], {})
            own[cut, addition] = own.get((cut, addition), 0) + 1
    rules = {}
    for suffix, edits in counts.items():
        n, edit = min((-n, edit) for edit, n in edits.items())
        if -n >= min_count and -n >= min_share * sum(edits.values()):
            rules[suffix] = (*edit, -n, sum(edits.values()))
    return {s: r for s, r in rules.items() if not s or s[1:] not in rules or rules[s[1:]][:2] != r[:2]}


def test_rules_against_brute_force(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choices("abé", k=rng.randint(1, 7))), "".join(rng.choices("abé", k=rng.randint(0, 7)))) for _ in range(400)]
    pairs += [(f, s) for s in stems(60) for f in inflections(s)]
    rows = [*pairs, pairs[0], (None, "a"), ("a", None), ("", "x")]
    for options in ({}, {"max_suffix": 2}, {"min_count": 1, "min_share": 0.0}):
        found = R.learn_lemma_rules(table(spark, rows), **options)
        assert {r.suffix: tuple(r)[1:] for r in found.collect()} == plain_rules(pairs, **options)


def test_held_out_accuracy(spark):
    """Of 600 forms of 200 stems that the rules have not seen."""
    known = stems(1200)
    held = set(known[::6])
    pairs = [(f, s) for s in known if s not in held for f in [s, *inflections(s)]]
    tests = {f: s for s in held for f in inflections(s)}
    rules = R.learn_lemma_rules(table(spark, pairs))
    guessed = {r.form: r.lemma for r in R.guess_lemmas(spark.createDataFrame([(f,) for f in tests], "form string"), rules).collect()}
    right = sum(guessed[f] == s for f, s in tests.items()) / len(tests)
    assert right >= 0.95
    trie = R.SuffixTrie([(r.suffix, r.cut, r.addition) for r in rules.collect()])
    assert {f: trie.lemma(f) for f in tests} == guessed


def test_the_longest_suffix_decides_and_nothing_is_emptied(spark):
    rules = spark.createDataFrame([("", 0, ""), ("s", 1, ""), ("ies", 3, "y"), ("abc", 3, "")], "suffix string, cut int, addition string")
    forms = spark.createDataFrame([("cats",), ("flies",), ("abc",), ("dog",), (None,), ("s",), ("cats",)], "form string")
    wanted = {"cats": "cat", "flies": "fly", "abc": "abc", "dog": "dog", "s": "s"}
    assert {r.form: r.lemma for r in R.guess_lemmas(forms, rules).collect()} == wanted
    trie = R.SuffixTrie([tuple(r) for r in rules.collect()])
    assert {f: trie.lemma(f) for f in wanted} == wanted
    none = rules.limit(0)
    assert {r.form: r.lemma for r in R.guess_lemmas(forms, none).collect()} == {f: f for f in wanted}
    assert R.SuffixTrie([]).lemma("cats") == "cats"


@pytest.fixture(scope="module")
def lemmas(spark):
    return table(spark, [("apples", "apple"), ("pears", "pear"), ("figs", "fig"), ("geese", "goose"), ("geese", "zzz")])


def test_table_first_then_rules_by_look_up_and_by_join(spark, lemmas, monkeypatch):
    rules = R.learn_lemma_rules(lemmas)
    rows = [(1, ["apples", "plums", "geese", None, "fog"], 7), (2, [], 8), (3, None, 9), (None, ["limes"], 1), (1, ["apples", "plums", "geese", None, "fog"], 7)]
    tokens = spark.createDataFrame(rows, "id long, tokens array<string>, form long")
    wanted = sorted([(1, ["apple", "plum", "goose", None, "fog"], 7)] * 2 + [(2, [], 8), (3, None, 9), (None, ["lime"], 1)], key=str)
    assert sorted(map(tuple, R.lemmatise_with_rules(tokens, lemmas, rules).collect()), key=str) == wanted
    monkeypatch.setattr(R, "is_small", lambda df: False)
    monkeypatch.setattr(C, "is_small", lambda df: False)
    assert sorted(map(tuple, R.lemmatise_with_rules(tokens, lemmas, rules).collect()), key=str) == wanted


@pytest.mark.parametrize("optimizer", ["online", "gibbs"])
def test_rules_belong_to_the_model(spark, lemmas, tmp_path, optimizer, monkeypatch):
    groups = ("apples pears plums figs limes", "irons zincs leads tins golds")
    texts = spark.createDataFrame([(i, " ".join(random.Random(i).choices(groups[i % 2].split(), k=20))) for i in range(40)], "id long, text string")
    corpus = ArticleCorpus(texts, lemmas=lemmas)
    corpus.learn_lemma_rules()
    assert {t for r in corpus.tokens().collect() for t in r.tokens} == {w[:-1] for g in groups for w in g.split()}
    options = {"maxIter": 2} if optimizer == "online" else {"iterations": 4, "sweeps_per_merge": 4}
    model = corpus.train(2, optimizer, seed=1, **options)
    E.save_model(model, str(tmp_path / "model"))
    loaded = E.load_model(spark, str(tmp_path / "model"))
    assert isinstance(loaded, T.TopicTable if optimizer == "gibbs" else E.TopicModel)
    unseen = spark.createDataFrame([(1, "plums limes"), (2, "golds tins")], "id long, text string")
    tagged = sorted(tuple(r) for r in E.tag_texts(model, unseen).collect())
    assert {r[0] for r in tagged} == {1, 2}
    assert sorted(tuple(r) for r in E.tag_texts(loaded, unseen).collect()) == tagged
    unseen.write.parquet(str(tmp_path / "arriving"))
    stream = read_article_stream(spark, str(tmp_path / "arriving"))
    tags, progress = str(tmp_path / "tags"), str(tmp_path / "progress")
    if optimizer == "online":
        write_tags(tag_stream(loaded, stream), tags, progress, available_now=True).awaitTermination()
    else:
        tag_in_batches(loaded, stream, tags, progress, available_now=True).awaitTermination()
    assert sorted(tuple(r)[:4] for r in spark.read.parquet(tags).select("id", "rank", "topic_id", "prob").collect()) == tagged
    monkeypatch.setattr(R, "is_small", lambda df: False)
    with pytest.raises(ValueError, match="tag_in_batches"):
        tag_stream(loaded, stream)


def test_rules_need_a_table(spark):
    with pytest.raises(ValueError, match="lemma table"):
        ArticleCorpus(spark.createDataFrame([(1, "a")], "id long, text string")).learn_lemma_rules()

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest

from newsloom.llm import periodic_runs as P


def brute(words, min_words=24, min_periods=3):
    """All maximal stretches of each period; one with two periods belongs to the smaller."""
    n, found = len(words), {}
    for q in range(1, n // min_periods + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(min_words, min_periods * q):
                found.setdefault((i - q, j - i + q), q)
            i = j + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def random_text(generator):
    letters = generator.choice(["a", "ab", "abc", "abcdefgh"])
    words = [generator.choice(letters) for _ in range(generator.randint(0, 60))]
    for _ in range(generator.randint(0, 3)):
        unit = [generator.choice("abc") for _ in range(generator.randint(1, 15))]
        unit = unit * 2 + unit[:1] if generator.random() < 0.5 else unit
        size, at = generator.randint(10, 100), generator.randint(0, len(words))
        words[at:at] = (unit * size)[:size]
    return generator.choice([" ", "  ", "\n", "\x0b"]).join(words) + generator.choice(["", " ", "\t"])


def test_runs_and_words_left_against_brute_force():
    generator = random.Random(1)
    texts = ["", " \t", "a " * 100, "a b " * 50 + "c " + "a b " * 40, "é 日 " * 30] + [random_text(generator) for _ in range(400)]
    words, bounds = P.split_words(pa.array(texts))
    found = P.find_in(words, bounds)
    kept = ~P.repeated(found, bounds)
    total = 0
    for text, own, a, b in zip(texts, found, bounds, bounds[1:], strict=False):
        listed = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert words[a:b].to_pylist() == listed
        wanted = brute(listed)
        assert own == wanted
        dropped = {i for start, length, q in wanted for i in range(start + q, start + length)}
        assert [w for i, w in enumerate(listed) if i not in dropped] == [w for w, k in zip(listed, kept[a:b], strict=True) if k]
        total += len(wanted)
    assert total > 300


@pytest.mark.parametrize(("min_words", "min_periods"), [(1, 3), (10, 4), (60, 3)])
def test_other_bounds(min_words, min_periods):
    generator = random.Random(2)
    texts = [random_text(generator) for _ in range(100)]
    words, bounds = P.split_words(pa.array(texts))
    for text, own in zip(texts, P.find_in(words, bounds, min_words, min_periods), strict=True):
        assert own == brute(text.split(), min_words, min_periods)


def test_less_than_three_periods_are_refused():
    with pytest.raises(ValueError, match="three periods"):
        P.find_in(*P.split_words(pa.array(["a"])), min_periods=2)


@pytest.mark.parametrize("text", ["a " * 500_000, "a b a c " * 125_000, "a b b a " * 30_000 + "c " + "a b b a " * 30_000])
def test_long_texts_of_few_words_take_little_time(text):
    began = time.monotonic()
    found = P.find_in(*P.split_words(pa.array([text])))[0]
    assert time.monotonic() - began < 20
    assert found
    assert all(length >= 24 for _, length, _ in found)


def test_runs_stop_at_the_ends_of_documents():
    words, bounds = P.split_words(pa.array(["a " * 20, "a " * 20, "", "a " * 30]))
    assert P.find_in(words, bounds) == [[], [], [], [(0, 30, 1)]]


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def wanted_row(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_against_brute_force(spark, odd_documents):
    generator = random.Random(4)
    rows = [(i, random_text(generator)) for i in range(600)] + [(i, " ".join(f"w{k}" for k in range(generator.randint(0, 300)))) for i in range(600, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionAll(odd_documents.where("doc_id is null or doc_id != 6").select("doc_id", "text"))
    found = P.digests(P.find_runs(P.with_planted_repeats(docs)))
    wanted = sorted([wanted_row(*r) for r in docs.collect()], key=repr)
    assert sorted([tuple(r) for r in found.collect()], key=repr) == wanted
    assert sum(r[1] > 1 for r in wanted) > 20


def test_odd_tables(odd_documents, no_documents):
    clashing = odd_documents.withColumnsRenamed({"n": "words", "size": "runs", "pattern": "a", "key": "g", "part": "collapsed"})
    found = {r["n_words"]: r for r in P.find_runs(P.with_planted_repeats(clashing)).where("doc_id = 6").collect()}
    assert found[30_000]["collapsed"] == "long"
    assert P.digests(P.find_runs(P.with_planted_repeats(clashing))).count() == odd_documents.count()
    assert P.digests(P.find_runs(P.with_planted_repeats(no_documents))).count() == 0

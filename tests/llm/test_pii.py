import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(number):
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(number))]
        return sum(d // 10 + d % 10 for d in doubled) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]


def base(text):
    return [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.sampled_from("a@.1 2-+()é\n49"), max_size=50))
def test_patterns(text):
    assert base(text) == brute(text)


def test_hard_patterns():
    for text in ["a@b.c@d.e", "a@@b.c", "x@y", "a@b..c", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", "4111 1111-1111 1111", "4111111111111112", "+1 (258) 555-7056 4445513251889405", "é@b.c", "+12345678+123456789", "a.b+c%d@e-f.g.h. x"]:
        assert base(text) == brute(text), text


def test_long_texts_take_linear_time():
    for text in ["a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1" * 100_000, "1." * 100_000, "+1" + "(" * 300_000]:
        pii.base_spans(text)
        pii.nodes_of(text)


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), max_docs=600)


def added(field, text):
    found, spans = pii.find_spans([text], field)[0]
    return [(pii.KINDS[k], text[a:b]) for k, a, b in spans if (k, a, b) not in found]


def test_field_adds_forms_that_patterns_miss(field):
    assert added(field, "call (482) 555-7951 now") == [("phone", "(482) 555-7951")]
    assert added(field, "from 77.43.128.25, then [77-43-128-25].") == [("ip", "77-43-128-25")]


def test_field_parts_what_runs_into_each_other(field):
    """Here a phone number is followed by a card number, and both patterns drop the whole."""
    text = "write +1 (314) 555-6532 4663622617512349 now"
    assert base(text) == []
    assert added(field, text) == [("card", "4663622617512349"), ("phone", "+1 (314) 555-6532")]


def test_ordinary_numbers_stay(field):
    for text in ["in 1999 and 2020", "at 12:30 on 3.5.2004 for $12.50", "page 7 of 120", "version 1.2.3", "no numbers", "100%", "chapter 12, part 3"]:
        assert added(field, text) == [], text


def test_repeated_tokens_share_their_label():
    """A token that is unclear alone takes the label of its clear repetition far away."""
    field = pii.Field(np.zeros((pii.FEATURES, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), 5.0 * np.eye(pii.LABELS))
    nodes = pii.nodes_of("id 5551234567 stands here, later again 555-123-4567.")
    assert nodes.skip == [(0, 1)] and nodes.chain == []
    features = list(pii.node_features(nodes))
    clear = next(f for f in features[0] if f not in features[1])
    field.state[clear, 3] = 6.0
    alone = pii.marginals(pii.build_graph([pii.nodes_of("555-123-4567.")]), field)
    both = pii.marginals(pii.build_graph([nodes]), field)
    assert alone[0, 3] == pytest.approx(1 / pii.LABELS) and both[1, 3] > 0.9


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(0)
    field = pii.Field(rng.normal(size=(pii.FEATURES, pii.LABELS)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    nodes = pii.Nodes([(0, 1)] * 4, ["a1", "b2", "c3", "d4"], [(0, 1), (1, 2)], [(1, 3)])
    graph = pii.build_graph([nodes])
    scores = graph.scores(field.state)
    weights = np.zeros((4, 5))
    for y in np.ndindex(5, 5, 5, 5):
        value = sum(scores[i, y[i]] for i in range(4)) + field.chain[y[0], y[1]] + field.chain[y[1], y[2]] + field.skip[y[1], y[3]]
        for i in range(4):
            weights[i, y[i]] += np.exp(value)
    assert pii.marginals(graph, field, 60) == pytest.approx(weights / weights.sum(axis=1, keepdims=True), abs=1e-3)


def test_query(documents):
    rows = {r["doc_id"]: r for r in pii.find_personal_data(documents).collect()}
    for doc in documents.collect():
        wanted, row = brute(doc["text"] or ""), rows[doc["doc_id"]]
        for kind in pii.KINDS:
            assert row[f"n_{kind}"] == sum(k == kind for k, _, _ in wanted)
        listed = [f"{k}:{a}:{b}" for k, a, b in wanted]
        assert row["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(row["spans"].split(",")) | {""}
        if not re.search("[0-9@]", doc["text"] or ""):
            assert row["spans"] == ""


def test_redact(documents, odd_documents, no_documents):
    out = pii.redact(documents)
    assert out.columns == documents.columns
    for row in out.collect():
        assert brute(row["text"] or "") == []
    cleaned = {r["doc_id"]: r["text"] for r in pii.redact(odd_documents).collect()}
    assert cleaned[2] is None and cleaned[3] == "" and cleaned[7].endswith("mail [EMAIL]")
    assert pii.redact(no_documents).count() == 0 and pii.find_personal_data(no_documents).count() == 0
    assert pii.find_personal_data(odd_documents).count() == odd_documents.count()


def test_mask():
    assert pii.mask("ab 12 cd", [(3, 3, 5)]) == "ab [PHONE] cd"
    assert pii.mask("0123456789", [(1, 2, 6), (2, 4, 8)]) == "01[IP]89"


def test_long_texts_of_digits_take_bounded_memory_and_linear_time():
    """In a process of its own: 2 MB of tokens that all repeat each other."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import resource, time, numpy as np
from newsloom.llm import pii
field = pii.Field(np.zeros((pii.FEATURES, pii.LABELS)), np.zeros((pii.LABELS,) * 2), np.zeros((pii.LABELS,) * 2))
field.state[:, pii.OUTSIDE] = 1.0
seconds = []
for n in (1 << 17, 1 << 20, 1 << 21):
    began = time.monotonic()
    assert pii.find_spans(["17 " * (n // 3)], field) == [([], [])]
    seconds.append(time.monotonic() - began)
assert seconds[2] < 4 * seconds[1] + 1, seconds
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 900_000, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
"""
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]

"""Personal data: patterns with checks, and a skip-chain conditional random field for what they miss.

The patterns find e-mail addresses, IP addresses, card numbers and phone numbers; a match that fails its
check is dropped. The field labels the tokens of a document that hold a digit or an ``@`` (all others are
outside by definition). Neighbouring tokens share a potential, and so do repeated or similar tokens
anywhere in the document (equal but for case and punctuation, or with the same seven digits or more),
each occurrence with the next one. Sum-product messages are passed over this loopy graph, so a label
that is clear in one place is carried to the others. Tokens with a probability of ``SURE`` or more that
touch no match of the patterns are added as spans; neighbours of one kind are one span.

The field is trained by pseudo-likelihood on at most ``MAX_DOCS`` documents, those that come first in
the order of a hash among documents with at most ``MAX_NODES`` such tokens. Their labels are the matches
of the patterns, without documents in which a long match was dropped; variants of the matches and ordinary numbers, made from templates, are added so that it
learns forms the patterns do not have.

Null texts are empty; texts without personal data have no spans. Whole texts are searched, in time in
proportion to their length; memory is a small multiple of the tokens of the longest text that hold a digit or
an ``@``. Positions are code points, ends exclusive. Repeated rows give equal results, an empty table an empty
one. Only ``doc_id`` and ``text`` are read; ``redact`` carries all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.text import pieces

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
LABELS = len(KINDS) + 1
MAX_DOCS = 2000
MAX_NODES = 256
MAX_TOKEN = 256
SURE = 0.95
# White space between neighbouring tokens.
MAX_GAP = 4
ROUNDS = 20
SEED = 1
FEATURES = 1 << 14
# Edges whose messages are renewed at once, and tokens whose features a document remembers.
EDGES = 1 << 16
KNOWN = 1 << 15

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match never starts within a run of digits that the last one did not end in.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPACE = re.compile(r"[\x20\x09-\x0D]")
MARK = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(map(int, reversed(digits))):
        total += digit if i % 2 == 0 else (2 * digit - 9 if digit > 4 else 2 * digit)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets_fit(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in match.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, found from each ``@``: the part before it is the run that ends there."""
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            yield start, end
        at = max(at + 1, end)


def matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """``(kind, start, end, passes)`` of all matches, by kind and start."""
    for a, b in _emails(text):
        yield 0, a, b, True
    for m in IP.finditer(text):
        yield 1, *m.span(), _octets_fit(m.group())
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        yield 2, *m.span(), 13 <= len(digits) <= 19 and luhn(digits)
    for m in PHONE.finditer(text):
        yield 3, *m.span(), 9 <= len(_digits(m.group())) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of all matches that pass their checks, by kind and start."""
    return [(k, a, b) for k, a, b, passes in matches(text) if passes]


def is_ambiguous(text: str) -> bool:
    """Whether a long match was dropped: it may hold personal data that ran into each other."""
    return any(not passes and b - a > 15 for _, a, b, passes in matches(text))


@dataclass
class Nodes:
    """Tokens with a digit or an ``@``: places, texts and the pairs that share a potential."""

    spans: list[tuple[int, int]]
    tokens: list[str]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def nodes_of(text: str) -> Nodes:
    spans: list[tuple[int, int]] = []
    end = 0
    while match := MARK.search(text, end):
        start = match.start()
        while start > end and not SPACE.match(text, start - 1):
            start -= 1
        stop = SPACE.search(text, match.end())
        end = stop.start() if stop else len(text)
        spans.append((start, end))
    tokens = [text[a:b] for a, b in spans]
    gaps = [(a, b) for (_, a), (b, _) in zip(spans, spans[1:], strict=False)]
    chain = [(i, i + 1) for i, (a, b) in enumerate(gaps) if b - a <= MAX_GAP and not text[a:b].strip(" \t\n\v\f\r")]
    skip, last = [], {}
    for i, token in enumerate(tokens):
        digits = _digits(token)
        key = digits if len(digits) >= 7 and "@" not in token else "".join(c for c in token.lower() if c.isalnum() or c == "@")
        if key in last:
            skip.append((last[key], i))
        last[key] = i
    return Nodes(spans, tokens, chain, skip)


def _shape(token: str) -> str:
    """Runs of letters as ``a``, of digits as ``d`` and their number, marks as they are."""
    return re.sub(r"[0-9]+", lambda m: f"d{min(len(m.group()), 20)}", re.sub(r"[^\W\d_]+", "a", token))


@lru_cache(maxsize=1 << 16)
def _feature(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % FEATURES


def _features_of(token: str, shape: str, before: str, after: str) -> array:
    digits = _digits(token)
    names = ["bias", f"s={shape}", f"r={re.sub(r'd[0-9]+', 'd', shape)}", f"n={min(len(digits), 20)}"]
    names += [f"p={before}", f"f={after}", f"p+={before}+{shape}", f"f+={shape}+{after}"]
    if 13 <= len(digits) <= 19:
        names.append(f"luhn={luhn(digits)}")
    parts = re.split(r"[^0-9]+", token.strip(".,;:!?\"'()[]"))
    if len(parts) == 4 and all(parts):
        names.append(f"octets={_octets_fit('.'.join(parts))}")
    if "@" in token:
        names.append(f"dot={'.' in token.rpartition('@')[2].strip('.')}")
    return array("H", [_feature(n) for n in names])


def node_features(nodes: Nodes) -> Iterator[array]:
    """Hashed features of each token, and of the shapes of the tokens that touch it."""
    shapes = [_shape(t.strip(".,;:!?\"'")) for t in nodes.tokens]
    before, after = {j: i for i, j in nodes.chain}, dict(nodes.chain)
    known: dict[tuple[str, str, str], array] = {}  # the same token between the same shapes is common
    for i, (token, shape) in enumerate(zip(nodes.tokens, shapes, strict=True)):
        key = (token, shapes[before[i]] if i in before else "", shapes[after[i]] if i in after else "")
        own = known.get(key)
        if own is None:
            if len(known) >= KNOWN:
                known.clear()
            own = known[key] = _features_of(token, shape, *key[1:])
        yield own


def labels_of(nodes: Nodes, spans: list[tuple[int, int, int]]) -> list[int]:
    out = [OUTSIDE] * len(nodes.spans)
    for kind, a, b in spans:
        for i, (s, e) in enumerate(nodes.spans):
            if s < b and a < e:
                out[i] = kind
    return out


def variants(kind: int, match: str, number: int) -> list[tuple[str, int]]:
    """Other forms of a match, and forms that only look like it, with their labels."""
    digits = _digits(match)
    if kind == 0:
        user, _, host = match.partition("@")
        return [(f"{user}@{host}", 0), (f"<{user}@{host}>", 0), (f"{user}@", OUTSIDE), (f"@{user}", OUTSIDE)]
    if kind == 1:
        parts = match.split(".")
        return [
            (f"{match}:{number % 9000 + 80}", 1),
            (f"[{match}]", 1),
            ("-".join(parts), 1),
            (f"{int(parts[0]) % 9}.{int(parts[1]) % 20}.{int(parts[2]) % 9}", OUTSIDE),
            (".".join([str(300 + number % 600), *parts[1:]]), OUTSIDE),
        ]
    if kind == 2:
        broken = digits[:-1] + str((int(digits[-1]) + 1 + number % 9) % 10)
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [(".".join(groups), 2), ("/".join(groups), 2), ("_".join(groups), 2), (broken, OUTSIDE), (digits[:9], OUTSIDE)]
    local = digits[-10:]
    return [
        (f"({local[:3]}) {local[3:6]}-{local[6:]}", 3),
        (f"{local[:3]}-{local[3:6]}-{local[6:]}", 3),
        (f"{local[:3]}.{local[3:6]}.{local[6:]}", 3),
        (local[-4:], OUTSIDE),
        (f"{local[:2]}-{local[3:5]}", OUTSIDE),
    ]


def ordinary_numbers(number: int) -> list[str]:
    """Numbers as they stand in texts that hold nothing personal."""
    year, a, b = 1900 + number % 150, number % 28 + 1, number // 7 % 12 + 1
    return [
        str(number % 10), str(number % 1000), str(number % 1_000_000), str(year), f"{year}-{b:02}-{a:02}", f"{a}/{b}/{year}",
        f"{a}.{b}.{year}", f"{b}:{a:02}", f"{a}.{b}", f"{number % 100}%", f"${number % 1000}.{a:02}", f"{a},{number % 1000:03}",
        f"#{number % 10000}", f"v{b}.{a}", f"{b}.{a}.{number % 20}", f"({year})", f"{a}-{b}", f"{number % 90}th", f"a{number % 100}b",
        f"{number % 10**9:09}", f"{number % 10**11:011}", f"{number * 7919 % 10**14:014}", f"[{a}]", f"x{number % 64}", f"{year}/{year + 1}",
    ]


@dataclass
class Field:
    """Log potentials: of features, of neighbours, and of repeated or similar tokens."""

    state: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


@dataclass
class Graph:
    """Nodes of many documents: features, edges and their kinds."""

    features: np.ndarray
    rows: np.ndarray
    size: int
    chain: np.ndarray
    skip: np.ndarray

    def scores(self, state: np.ndarray) -> np.ndarray:
        out = np.zeros((self.size, LABELS))
        for k in range(LABELS if self.size else 0):
            out[:, k] = np.bincount(self.rows, weights=state[self.features, k], minlength=self.size)
        return out


def build_graph(documents: list[Nodes]) -> Graph:
    features, counts, pairs, size = array("H"), array("B"), (array("i"), array("i")), 0
    for nodes in documents:
        for own in node_features(nodes):
            features.extend(own)
            counts.append(len(own))
        for flat, edges in zip(pairs, (nodes.chain, nodes.skip), strict=True):
            for i, j in edges:
                flat.append(size + i)
                flat.append(size + j)
        size += len(nodes.tokens)
    rows = np.repeat(np.arange(size, dtype=np.int32), np.frombuffer(counts, dtype=np.uint8) if size else 0)
    chain, skip = (np.array(flat, dtype=np.int32).reshape(-1, 2) for flat in pairs)
    return Graph(np.array(features, dtype=np.int32), rows, size, chain, skip)


def train(documents: list[Nodes], labels: list[list[int]], steps: int = 300, rate: float = 0.1) -> Field:
    """Maximum pseudo-likelihood by Adam, with a small penalty on the weights."""
    graph = build_graph(documents)
    y = np.array([k for own in labels for k in own], dtype=np.int64)
    field = [np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))]
    if not len(y):
        field[0][:, OUTSIDE] = 1.0
        return Field(*field)
    first, second = [np.zeros_like(p) for p in field], [np.zeros_like(p) for p in field]
    truth = np.eye(LABELS)[y]
    for step in range(1, steps + 1):
        out = graph.scores(field[0])
        for pairs, table in ((graph.chain, field[1]), (graph.skip, field[2])):
            np.add.at(out, pairs[:, 0], table[:, y[pairs[:, 1]]].T)
            np.add.at(out, pairs[:, 1], table[y[pairs[:, 0]]])
        out = np.exp(out - out.max(axis=1, keepdims=True))
        error = (out / out.sum(axis=1, keepdims=True) - truth) / len(y)
        grads = [np.zeros_like(p) for p in field]
        np.add.at(grads[0], graph.features, error[graph.rows])
        for k, pairs in ((1, graph.chain), (2, graph.skip)):
            np.add.at(grads[k].T, y[pairs[:, 1]], error[pairs[:, 0]])
            np.add.at(grads[k], y[pairs[:, 0]], error[pairs[:, 1]])
        for k, grad in enumerate(grads):
            grad += 1e-6 * field[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            scale = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            field[k] -= rate * scale * first[k] / (np.sqrt(second[k]) + 1e-8)
    return Field(*field)


def _sum_at(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add each row of ``values`` to the row of ``out`` it belongs to."""
    for k in range(out.shape[1]):
        out[:, k] += np.bincount(rows, weights=values[:, k], minlength=len(out))


def marginals(graph: Graph, field: Field, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of the labels of each node by damped sum-product messages.

    One message per edge and direction is kept; what it takes to renew them is held for ``EDGES`` of them
    at a time, so that memory is a small multiple of the number of edges.
    """
    scores = graph.scores(field.state)
    # Sender, taker and table of all messages of a kind and direction, and where the messages back stand.
    kinds, at = [], 0
    for pairs, table in ((graph.chain, field.chain), (graph.skip, field.skip)):
        n = len(pairs)
        kinds += [(at, pairs[:, 0], pairs[:, 1], table, at + n), (at + n, pairs[:, 1], pairs[:, 0], table.T, at)]
        at += 2 * n
    messages = np.zeros((at, LABELS), dtype=np.float32)

    def beliefs() -> np.ndarray:
        out = scores.copy()
        for first, senders, takers, _, _ in kinds:
            _sum_at(out, takers, messages[first : first + len(senders)])
        return out

    for _ in range(rounds if at else 0):
        belief, change = beliefs(), 0.0
        renewed = np.empty_like(messages)
        for first, senders, _, table, back in kinds:
            for low in range(0, len(senders), EDGES):
                own = slice(low, min(low + EDGES, len(senders)))
                sent = (belief[senders[own]] - messages[back + own.start : back + own.stop])[:, :, None] + table
                top = sent.max(axis=1)
                new = top + np.log(np.exp(sent - top[:, None]).sum(axis=1))
                new -= new.max(axis=1, keepdims=True)
                old = messages[first + own.start : first + own.stop]
                change = max(change, float(np.abs(new - old).max()))
                renewed[first + own.start : first + own.stop] = 0.5 * old + 0.5 * new
        messages = renewed
        if change < 1e-4:
            break
    belief = beliefs()
    out = np.exp(belief - belief.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def added_spans(nodes: Nodes, probabilities: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of tokens that are surely of a kind and touch no match; neighbours of a kind are one span."""
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken], dtype=np.int64)
    ends = np.maximum.accumulate(np.array([b for _, b in taken], dtype=np.int64)) if taken else starts
    linked, out, last = set(nodes.chain), [], (-2, OUTSIDE)
    for i, (a, b) in enumerate(nodes.spans):
        kind = int(probabilities[i].argmax())
        before = int(np.searchsorted(starts, b))
        touches = before > 0 and ends[before - 1] > a
        if kind == OUTSIDE or probabilities[i, kind] < SURE or touches:
            continue
        token = nodes.tokens[i]
        lead = len(token) - len(token.lstrip(".,;:!?\"'<[{"))
        tail = len(token) - len(token.rstrip(".,;:!?\"'>]}"))
        if last == (i - 1, kind) and (i - 1, i) in linked:
            out[-1] = (kind, out[-1][1], b - tail)
        else:
            out.append((kind, a + lead, b - tail))
        last = (i, kind)
    return [span for span in out if span[2] > span[1]]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def training_documents(docs: DataFrame, max_docs: int = MAX_DOCS, seed: int = SEED) -> list[str]:
    """Excerpts of sample documents: their tokens with a digit or an ``@``, apart where they do not touch."""

    def excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            marked = pc.filter(batch.column(1), pc.match_substring_regex(batch.column(1), "[0-9@]"))
            kept = []
            for text in marked.to_pylist():
                nodes = nodes_of(text)
                if len(nodes.tokens) <= MAX_NODES and max(map(len, nodes.tokens)) <= MAX_TOKEN:
                    linked = set(nodes.chain)
                    gaps = [" " if (i, i + 1) in linked else " _ " for i in range(len(nodes.tokens))]
                    kept.append("".join(t + g for t, g in zip(nodes.tokens, gaps, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], names=["excerpt"])

    found = _documents(docs).mapInArrow(excerpts, "excerpt string")
    chosen = found.orderBy(F.xxhash64("excerpt", F.lit(seed)), "excerpt").limit(max_docs).toPandas()
    return chosen["excerpt"].tolist()


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, seed: int = SEED) -> Field:
    """Train the field on a bounded sample of ``docs``, labelled by the patterns."""
    documents, labels = [], []

    def add(text: str, spans: list[tuple[int, int, int]]) -> None:
        nodes = nodes_of(text)
        documents.append(nodes)
        labels.append(labels_of(nodes, spans))

    for number, text in enumerate(training_documents(docs, max_docs, seed)):
        spans = base_spans(text)
        if not is_ambiguous(text):
            add(text, spans)
        for k, (kind, a, b) in enumerate(spans):
            forms = variants(kind, text[a:b], 31 * number + 17 * k + 7)
            form, label = forms[(number + k) % len(forms)]
            add(f"{form} _ {form}" if number % 3 == 0 else form, [(label, 0, 10**9)] if label != OUTSIDE else [])
        plain = ordinary_numbers(104_729 * (number + 1) % 999_983)
        add(f"{plain[number % len(plain)]} _ {plain[(number // 5) % len(plain)]}", [])
    return train(documents, labels)


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_spans(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """Base spans and all spans of each text."""
    bases = [base_spans(t) if MARK.search(t) else [] for t in texts]
    documents = [nodes_of(t) for t in texts]
    graph = build_graph(documents)
    probabilities = marginals(graph, field) if graph.size else np.zeros((0, LABELS))
    out, low = [], 0
    for base, nodes in zip(bases, documents, strict=True):
        own = probabilities[low : low + len(nodes.tokens)]
        low += len(nodes.tokens)
        out.append((base, sorted(set(base) | set(added_spans(nodes, own, base)))))
    return out


def _searched(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[tuple[pa.RecordBatch, list[tuple[list, list]]]]:
    """Pieces of batches with the spans of their rows; texts without any mark are passed over."""
    for batch in pieces(batches, 1):
        marked = np.flatnonzero(pc.match_substring_regex(batch.column(1), "[0-9@]").to_numpy(zero_copy_only=False))
        found: list[tuple[list, list]] = [([], [])] * batch.num_rows
        for row, spans in zip(marked.tolist(), find_spans(batch.column(1).take(pa.array(marked)).to_pylist(), field), strict=True):
            found[row] = spans
        yield batch, found


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per document: ``n_email, n_ip, n_card, n_phone`` and ``base_sha256`` of the patterns' matches, and
    ``spans`` with those the field adds, as ``kind:start:end``."""
    sent = docs.sparkSession.sparkContext.broadcast(field or fit(docs))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _searched(batches, sent.value):
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            digests = [hashlib.sha256(_join(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([_join(s) for _, s in found], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    fields = ", ".join(f"n_{k} long" for k in KINDS)
    return _documents(docs).mapInArrow(search, f"doc_id long, {fields}, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Replace spans by the name of their kind; of overlapping spans the first one names all."""
    out, end = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= end:
            out += [text[end:a], f"[{KINDS[kind].upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by ``[EMAIL]`` and the like; null stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(field or fit(docs))

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        out = texts.tolist()
        batch = pa.RecordBatch.from_arrays([pa.nulls(len(out)), pa.array(out, pa.string())], names=["none", "text"])
        row = 0
        for _, found in _searched([batch], sent.value):
            for _, spans in found:
                if spans:
                    out[row] = mask(out[row], spans)
                row += 1
        return pd.Series(out, dtype=object)

    text = F.when(F.col("text").isNotNull(), cleaned(F.coalesce("text", F.lit(""))))
    return docs.withColumn("text", text)


"""Secrets: patterns for known forms, and a character convolutional network for other ones.

The patterns find assignments to a password, secret, token or key, access keys and long runs of hexadecimal
digits; a match that fails its check is dropped. Candidates are all other runs of 12 characters or more that
keys are written with and that hold a digit. The network reads each candidate whole, with 24 characters
before it and 8 after it: every character is one of 256 (ASCII, inside or outside of the candidate), one of
two for the rest, or padding, which weighs nothing; 32 filters slide over five characters, their maxima over all places go through
a hidden layer to one score.

It is trained on labelled findings: candidates that matches of the patterns touch are secrets, other ones are
not; all different ones, of any length. Values put into other surroundings and forms, and ordinary names and
numbers, ``MADE`` of each, are added so that it learns forms that the patterns do not have. Findings are dealt into
parts by a hash of their value, a task for each; in every epoch each part goes through its findings and all made
ones in mini batches, and the parts' networks are averaged. A quarter of the findings is held out of
training: on it scores are calibrated to probabilities (Platt scaling), and the threshold of each alphabet is
the largest one that ``RECALL`` of its secrets reach, but one half at least; made ones weigh what they weigh in
training. The driver holds one network and one score per finding held out. Candidates that reach the threshold and
touch no match are added as spans of kind ``learned``; a base span is never dropped.

A null text is empty; texts without candidates have no spans. Whole texts and whole candidates are read, in
time in proportion to their length and blocks of 65,536 characters. Positions are code points, ends
exclusive. Repeated rows give equal results, an empty table an empty one (the network then learns from made
findings alone). Only ``doc_id`` and ``text`` are read; ``redact`` carries all columns, and changes ``text``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.staging import stage
from newsloom.llm.text import pieces

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "learned")
LEARNED = KINDS.index("learned")
MIN_VALUE = 12
MIN_ACCESS = 18

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~-]{12,}")
# Texts without any of these have neither matches nor candidates.
ANY = r"[A-Za-z0-9+/_.=~-]{12,}"
DIGIT = re.compile(r"[0-9]")
EDGES = ".-=/_~+"
ALPHABETS = (re.compile(r"[0-9a-fA-F-]+"), re.compile(r"[0-9A-Z]+"))
BEFORE, AFTER = 24, 8
RADIUS = 2
FILTERS, HIDDEN = 32, 16
OTHER = 128
INSIDE = 129
PADDING = 2 * INSIDE
CLASSES = PADDING + 1
BLOCK = 1 << 16
CANDIDATES_AT_ONCE = 4096

MADE = 2000
# What a part has about: findings, and characters of them.
PART_FINDINGS = 4096
PART_CHARACTERS = 1 << 22
# Networks that a task adds up, and sums that the driver adds up.
SUMS = 32
RECALL = 0.95
HELD_OUT = 4
EPOCHS, BATCH, RATE = 12, 128, 0.01
SEED = 1

FINDING = "struct<kind:string,start:bigint,end:bigint,learned:boolean,probability:double>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of all matches that pass their checks, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Runs of key characters with a digit, without marks at their ends."""
    for match in CANDIDATE.finditer(text):
        run = match.group()
        start = match.start() + len(run) - len(run.lstrip(EDGES))
        end = match.end() - len(run) + len(run.rstrip(EDGES))
        if end - start >= MIN_VALUE and DIGIT.search(text, start, end):
            yield start, end


def _touched(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> np.ndarray:
    """Which spans share a character with a match."""
    taken = sorted((a, b) for a, _, b in base)
    if not spans or not taken:
        return np.zeros(len(spans), dtype=bool)
    starts, ends = (np.array(x, dtype=np.int64) for x in zip(*taken, strict=True))
    low, high = (np.array(x, dtype=np.int64) for x in zip(*spans, strict=True))
    before = np.searchsorted(starts, high)
    reach = np.concatenate(([-1], np.maximum.accumulate(ends)))
    return reach[before] > low


def alphabet(value: str) -> int:
    """Hexadecimal, upper-case or any other value."""
    return next((k for k, form in enumerate(ALPHABETS) if form.fullmatch(value)), len(ALPHABETS))


# --- the network ---


@dataclass
class Windows:
    """Candidates with their surroundings, as classes of characters with padding around each."""

    classes: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def take(self, rows: np.ndarray) -> Windows:
        ends = np.append(self.starts[1:], len(self.classes))
        sizes = (ends - self.starts)[rows]
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        at = np.repeat(self.starts[rows] - starts, sizes) + np.arange(sizes.sum())
        return Windows(self.classes[at], starts)


def classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.minimum(codes, OTHER).astype(np.int16)


def windows(codes: np.ndarray, spans: list[tuple[int, int]]) -> Windows:
    """The windows of candidates of one text, given as classes."""
    a, b = (np.array(x, dtype=np.int64) for x in zip(*spans, strict=True))
    low, high = np.maximum(a - BEFORE, 0), np.minimum(b + AFTER, len(codes))
    sizes = high - low + 2 * RADIUS
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    # Places in the text of all window positions; padding lies outside of the window.
    at = np.repeat(low - RADIUS - starts, sizes) + np.arange(sizes.sum())
    of = lambda x: np.repeat(x, sizes)
    real = (at >= of(low)) & (at < of(high))
    out = np.full(len(at), PADDING, dtype=np.int16)
    out[real] = codes[at[real]]
    out[real & (at >= of(a)) & (at < of(b))] += INSIDE
    return Windows(out, starts)


def joined(parts: list[Windows]) -> Windows:
    shifts = np.concatenate(([0], np.cumsum([len(p.classes) for p in parts])))
    return Windows(
        np.concatenate([np.zeros(0, dtype=np.int16), *(p.classes for p in parts)]),
        np.concatenate([np.zeros(0, dtype=np.int64), *(p.starts + s for p, s in zip(parts, shifts, strict=False))]),
    )


def _filtered(weights: np.ndarray, classes: np.ndarray, low: int, high: int) -> np.ndarray:
    """What the filters say at the places ``low`` to ``high``."""
    out = np.zeros((high - low, weights.shape[2]), dtype=np.float32)
    for k in range(2 * RADIUS + 1):
        a, b = max(low + k - RADIUS, 0), min(high + k - RADIUS, len(classes))
        out[a - low - k + RADIUS : b - low - k + RADIUS] += weights[k][classes[a:b]]
    return out


@dataclass
class Network:
    """Weights of filters, hidden layer and score; calibration; a threshold for each alphabet."""

    filters: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    score: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: list[float] = field(default_factory=lambda: [1.0] * (len(ALPHABETS) + 1))

    def maxima(self, found: Windows) -> np.ndarray:
        """The maximum of each filter over each window, a block of characters at a time."""
        out = np.zeros((len(found), self.filters.shape[2]), dtype=np.float32)
        for low in range(0, len(found.classes), BLOCK):
            high = min(low + BLOCK, len(found.classes))
            said = _filtered(self.filters, found.classes, low, high)
            first = int(np.searchsorted(found.starts, low, side="right")) - 1
            last = int(np.searchsorted(found.starts, high))
            cuts = np.maximum(found.starts[first:last], low) - low
            out[first:last] = np.maximum(out[first:last], np.maximum.reduceat(said, cuts, axis=0))
        return out

    def logits(self, found: Windows) -> np.ndarray:
        hidden = np.maximum(self.maxima(found) @ self.hidden + self.hidden_bias, 0)
        return hidden @ self.score[:-1] + self.score[-1]

    def probabilities(self, found: Windows) -> np.ndarray:
        return self.scaled(self.logits(found).astype(np.float64))

    def scaled(self, logits: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * logits + b, -50, 50)))


def _winners(said: np.ndarray, top: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first place at which each filter reaches its positive maximum: ``(place, window, filter)``."""
    place, of = np.nonzero((said == top[owner]) & (said > 0))
    _, first = np.unique(owner[place] * said.shape[1] + of, return_index=True)
    return place[first], owner[place[first]], of[first]


def _peaks(weights: np.ndarray, found: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The maximum of each filter over each window, 0 at least, and the first place of each positive one as
    ``(place, window, filter)``, a block of characters at a time."""
    top = np.zeros((len(found), weights.shape[2]), dtype=np.float32)
    places = np.full(top.shape, -1, dtype=np.int64)
    for low in range(0, len(found.classes), BLOCK):
        high = min(low + BLOCK, len(found.classes))
        said = _filtered(weights, found.classes, low, high)
        first = int(np.searchsorted(found.starts, low, side="right")) - 1
        last = int(np.searchsorted(found.starts, high))
        cuts = np.maximum(found.starts[first:last], low) - low
        best = np.maximum.reduceat(said, cuts, axis=0)
        owner = np.repeat(np.arange(last - first), np.diff(cuts, append=high - low))
        place, window, of = _winners(said, best, owner)
        better = best[window, of] > top[first + window, of]
        places[first + window[better], of[better]] = low + place[better]
        top[first:last] = np.maximum(top[first:last], best)
    window, of = np.nonzero(places >= 0)
    return top, places[window, of], window, of


@dataclass
class Training:
    """Weights of the network and their moments, of which a batch changes all."""

    weights: list[np.ndarray]
    moments: list[list[np.ndarray]]

    @classmethod
    def begin(cls, seed: int) -> Training:
        random = np.random.default_rng(seed)
        shapes = [(2 * RADIUS + 1, CLASSES, FILTERS), (FILTERS, HIDDEN), (HIDDEN,), (HIDDEN + 1,)]
        spread = (0.1, FILTERS**-0.5, 0.0, HIDDEN**-0.5)
        weights = [(random.standard_normal(s) * d).astype(np.float32) for s, d in zip(shapes, spread, strict=True)]
        weights[0][:, PADDING] = 0
        return cls(weights, [[np.zeros_like(w) for w in weights] for _ in range(2)])

    def numbers(self) -> np.ndarray:
        return np.concatenate([w.ravel() for group in (self.weights, *self.moments) for w in group])

    def with_numbers(self, numbers: np.ndarray) -> Training:
        groups, done = [], 0
        for group in (self.weights, *self.moments):
            groups.append([])
            for w in group:
                groups[-1].append(numbers[done : done + w.size].reshape(w.shape).astype(np.float32))
                done += w.size
        return Training(groups[0], groups[1:])

    def epoch(self, found: Windows, labels: np.ndarray, random: np.random.Generator, step: int) -> int:
        """Logistic loss by Adam on mini batches of all findings, both classes of equal weight; the next step."""
        net = Network(*self.weights)
        share = np.bincount(labels, minlength=2) / max(len(labels), 1)
        weight = 0.5 / np.maximum(share, 1e-9)
        order = random.permutation(len(labels))
        for low in range(0, len(order), BATCH):
            rows = order[low : low + BATCH]
            batch, truth = found.take(rows), labels[rows]
            top, place, window, of = _peaks(net.filters, batch)
            inner = top @ net.hidden + net.hidden_bias
            active = np.maximum(inner, 0)
            logit = active @ net.score[:-1] + net.score[-1]
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - truth) * weight[truth] / len(rows)
            back = np.outer(error, net.score[:-1]) * (inner > 0)
            pull = (back @ net.hidden.T)[window, of]
            grads = [np.zeros_like(w) for w in self.weights]
            for k in range(2 * RADIUS + 1):
                at = place + k - RADIUS
                there = (at >= 0) & (at < len(batch.classes))
                np.add.at(grads[0][k], (batch.classes[at[there]], of[there]), pull[there])
            grads[0][:, PADDING] = 0  # padding says nothing, like the ends of all windows
            grads[1] += top.T @ back
            grads[2] += back.sum(axis=0)
            grads[3] += np.append(active.T @ error, error.sum())
            step += 1
            for w, g, first, second in zip(self.weights, grads, *self.moments, strict=True):
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        return step


def train_network(found: Windows, labels: np.ndarray, seed: int = SEED, epochs: int = EPOCHS) -> Network:
    """A network trained on findings that one task holds."""
    training, random, step = Training.begin(seed), np.random.default_rng([seed, 0]), 0
    for _ in range(epochs):
        step = training.epoch(found, labels, random, step)
    return Network(*training.weights)


def calibrate(net: Network, logits: np.ndarray, labels: np.ndarray, alphabets: np.ndarray, weights: np.ndarray, recall: float = RECALL) -> None:
    """Fit the scale of the scores, then the thresholds, on findings held out of training, which weigh ``weights``."""
    a, b = 1.0, 0.0
    # Platt's targets keep the fit finite when the classes are apart.
    n = np.bincount(labels, weights=weights, minlength=2)
    target = np.where(labels == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    design = np.stack((logits, np.ones_like(logits)), axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -50, 50)))
        slope = design.T @ (weights * (p - target)) + 1e-6 * np.array([a, b])
        bend = (design * (weights * p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        move = np.linalg.solve(bend, slope)
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -5, 5))
    net.scale = (a, b)
    p = net.scaled(logits)
    for k in range(len(net.thresholds)):
        own = (labels == 1) & (alphabets == k)
        own = own if own.any() else labels == 1
        order = np.argsort(p[own], kind="stable")
        passed = np.cumsum(weights[own][order])
        at = int(np.searchsorted(passed, (1 - recall) * passed[-1], side="right")) if len(passed) else 0
        reached = float(p[own][order[min(at, len(order) - 1)]]) if len(passed) else 1.0
        net.thresholds[k] = max(0.5, reached)


# --- findings to learn from ---

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Forms of secrets, and of addresses, files, things and times that are none.
SECRET_FORMS = (
    "{m40}", "{h32}", "{u20}", "ghp_{m36}", "sk_live_{m24}", "xoxb-{d12}-{m24}", "Bearer {m48}", "pwd={m16}", "auth: {m32}",
    "client_key = '{m32}'", "\"credential\": \"{m40}\"", "private key {h64}", "access={u24}", "eyJ{m20}.{m40}.{m30}",
    "key: {x32}", "{x40}", "signature={x64}", "login {l6}:{m20}",
)
PLAIN_FORMS = (
    "{d3}.{d3}.{d3}.{d3}", "mail{d1}.{l7}.com", "{l5}.{d2}@mail{d1}.{l7}.com", "20{d2}-0{d1}-1{d1}T0{d1}", "{l6}_{l5}_{d2}", "{l8}/{l6}/{d4}.html",
    "https://www.{l7}.org/{l5}/{d3}", "{d1}.{d2}.{d3}-{l5}{d1}", "{l6}-{l8}-{d4}", "978-{d1}-{d2}-{d6}-{d1}", "+{d2}-{d3}-{d4}-{d4}", "{l5}_{l4}_{d1}.txt",
    "{d3}{d3}{d3}{d4}", "chapter-{d2}-{l7}", "{l9}{l6}{d1}", "{U8}-{d3}-{U6}", "version={d1}.{d2}.{d2}", "x={d6}.{d6}", "{l4}.{l6}.{l5}[{d1}]", "IMG_20{d6}_{d6}.jpg",
    "ISSN:{d4}-{d4}/{d4}", "0{d2}/{d2}/20{d2}-{d2}", "{l7}+{l8}={d4}", "{h8}-{h4}-{h4}-{h4}-{h12}", "{d4}-{d4}-{d4}",
)
LETTERS = {"m": LOWER + UPPER + DIGITS, "h": "0123456789abcdef", "x": "0123456789ABCDEF", "u": UPPER + DIGITS, "U": UPPER, "l": LOWER, "d": DIGITS}
SLOT = re.compile(r"\{([mhxuUld])([0-9]+)\}")


def made_up(form: str, random: np.random.Generator) -> str:
    """A form with its slots filled with random characters."""
    return SLOT.sub(lambda m: "".join(random.choice(list(LETTERS[m[1]]), int(m[2]))), form)


def _findings(docs: DataFrame, seed: int) -> DataFrame:
    """``(before, value, after, secret, order)`` of all different candidates of whole texts, stored."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            column = batch.column(1)
            rows = []
            for text in column.filter(pc.match_substring_regex(column, ANY)).to_pylist():
                spans = list(candidates(text))
                for (a, b), secret in zip(spans, _touched(spans, base_spans(text)).tolist(), strict=True):
                    rows.append((text[max(0, a - BEFORE) : a], text[a:b], text[b : b + AFTER], secret))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["before", "value", "after", "secret"])

    found = _documents(docs).mapInArrow(look, "before string, value string, after string, secret boolean")
    # One finding per value, whatever stands around it, so that copies do not outweigh the others.
    found = found.groupBy("value", "secret").agg(F.min(F.struct("before", "after")).alias("around"))
    return stage(found.select("around.before", "value", "around.after", "secret", F.xxhash64("value", F.lit(seed)).alias("order")), "findings")


def made_findings(surroundings: list[tuple[str, str]], seed: int = SEED, made: int = MADE) -> tuple[list[tuple[str, str, str]], np.ndarray]:
    """``(before, value, after)`` and labels of made findings, some of them between ``(before, after)`` of others."""
    random = np.random.default_rng(seed)
    surroundings = surroundings or [("the number ", " of the")]
    out, y = [], []
    for i in range(made):
        around = surroundings[i % len(surroundings)]
        for forms, label in ((SECRET_FORMS, 1), (PLAIN_FORMS, 0)):
            text = made_up(forms[i % len(forms)], random)
            before = around[0][: BEFORE - len(text) % 7] if i % 3 else ""
            whole = f"{before} {text}{around[1] or ' '}"
            spans = [s for s in candidates(whole) if s[0] > len(before)]
            for a, b in spans[:1]:
                out.append((whole[max(0, a - BEFORE) : a], whole[a:b], whole[b : b + AFTER]))
                y.append(label)
    return out, np.array(y, dtype=np.int64)


def _windows_of(findings: list[tuple[str, str, str]]) -> Windows:
    return joined([windows(classes_of(b + v + a), [(len(b), len(b) + len(v))]) for b, v, a in findings])


def _alphabets(findings: list[tuple[str, str, str]]) -> np.ndarray:
    return np.array([alphabet(v) for _, v, _ in findings], dtype=np.int64)


def _rows_of(batch: pa.RecordBatch | pa.Table) -> list[tuple[str, str, str]]:
    return list(zip(*(batch.column(name).to_pylist() for name in ("before", "value", "after")), strict=True))


def fit(docs: DataFrame, recall: float = RECALL, seed: int = SEED) -> Network:
    """A network trained and calibrated on all findings in ``docs``."""
    context = docs.sparkSession.sparkContext
    findings = _findings(docs, seed)
    n, size = findings.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("value")), F.lit(0))).first()
    parts = max(1, math.ceil(n / PART_FINDINGS), math.ceil(size / PART_CHARACTERS))
    # As many surroundings as made findings need.
    around = findings.where(~F.col("secret")).orderBy("order", "value", "before").limit(MADE).select("before", "after").collect()
    made, labels = made_findings([tuple(row) for row in around], seed)
    # Mixed before they are dealt out, as findings of a form follow each other at equal distances.
    order = np.random.default_rng(seed).permutation(len(labels))
    held, kept = order[: len(order) // HELD_OUT], order[len(order) // HELD_OUT :]
    own = _windows_of(made)
    sent_made = context.broadcast((own.take(kept), labels[kept]))
    is_held = F.pmod("order", F.lit(HELD_OUT)) == 0
    dealt = findings.where(~is_held).repartitionById(parts, F.pmod(F.xxhash64("order", F.lit(seed)), F.lit(parts)).cast("int"))

    training = Training.begin(seed)
    for epoch in range(EPOCHS):
        sent = context.broadcast(training)

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, epoch=epoch) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            rows = sorted((row, secret) for batch in batches for row, secret in zip(_rows_of(batch), batch.column("secret").to_pylist(), strict=True))
            found = joined([_windows_of([row for row, _ in rows]), sent_made.value[0]])
            truth = np.concatenate((np.array([secret for _, secret in rows], dtype=np.int64), sent_made.value[1]))
            own = sent.value.with_numbers(sent.value.numbers())
            own.epoch(found, truth, np.random.default_rng([seed, part, epoch]), epoch * math.ceil(len(truth) / BATCH))
            sums = pa.array([own.numbers().astype(np.float64) * len(truth)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([float(len(truth))]), sums], names=["part", "n", "sums"])

        trained = dealt.mapInArrow(learn, "part long, n double, sums array<double>")
        total = _added(trained, parts)
        training = training.with_numbers(total[1:] / total[0])
        sent.destroy()

    net = Network(*training.weights)
    sent_net = context.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            rows = _rows_of(batch)
            logits = sent_net.value.logits(_windows_of(rows)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(logits), batch.column("secret"), pa.array(_alphabets(rows))], names=["logit", "secret", "alphabet"])

    scored = findings.where(is_held).mapInArrow(score, "logit double, secret boolean, alphabet long").orderBy("logit", "secret", "alphabet").toArrow()
    columns = [scored.column(name).to_numpy() for name in ("logit", "secret", "alphabet")]
    # Every part has all made findings.
    weights = np.concatenate((np.ones(len(scored)), np.full(len(held), float(parts))))
    calibrate(
        net, np.concatenate((columns[0], net.logits(own.take(held)).astype(np.float64))), np.concatenate((columns[1].astype(np.int64), labels[held])),
        np.concatenate((columns[2], _alphabets(made)[held])), weights, recall,
    )
    return net


def _added(rows: DataFrame, parts: int) -> np.ndarray:
    """``n`` and ``sums`` of all parts added up: by tasks first, so that the driver reads few rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, n, sums in zip(*(batch.column(name) for name in ("part", "n", "sums")), strict=True):
                found[part.as_py()] = np.append(n.as_py(), sums.values.to_numpy())
        if found:
            total = sum(found[part] for part in sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array([min(found)]), pa.array([total[0]]), pa.array([total[1:]], pa.list_(pa.float64()))], names=["part", "n", "sums"])

    if parts > SUMS:
        rows = rows.repartitionById(SUMS, F.pmod("part", F.lit(SUMS)).cast("int")).mapInArrow(add, "part long, n double, sums array<double>")
    found = rows.toArrow().sort_by("part")
    return sum(np.append(n.as_py(), sums.values.to_numpy()) for n, sums in zip(found.column("n"), found.column("sums"), strict=True))


# --- search ---


def learned_spans(text: str, base: list[tuple[int, int, int]], net: Network) -> list[tuple[int, int, float]]:
    """``(start, end, probability)`` of candidates that touch no match and reach their threshold."""
    spans = list(candidates(text))
    spans = [s for s, touched in zip(spans, _touched(spans, base).tolist(), strict=True) if not touched]
    if not spans:
        return []
    codes, out = classes_of(text), []
    for low in range(0, len(spans), CANDIDATES_AT_ONCE):
        part = spans[low : low + CANDIDATES_AT_ONCE]
        for (a, b), p in zip(part, net.probabilities(windows(codes, part)).tolist(), strict=True):
            if p >= net.thresholds[alphabet(text[a:b])]:
                out.append((a, b, p))
    return out


def find_in(text: str, net: Network) -> list[tuple[int, int, int, float | None]]:
    """``(start, kind, end, probability)`` of all spans of a text, by start and kind."""
    base = base_spans(text)
    return sorted([(a, k, b, None) for a, k, b in base] + [(a, LEARNED, b, p) for a, b, p in learned_spans(text, base, net)], key=lambda s: s[:3])


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _searched(column: pa.Array, net: Network) -> list[list[tuple[int, int, int, float | None]]]:
    out: list[list] = [[] for _ in range(len(column))]
    rows = np.flatnonzero(pc.match_substring_regex(column, ANY).to_numpy(zero_copy_only=False))
    for row in rows.tolist():
        out[row] = find_in(column[row].as_py(), net)
    return out


def find_secrets(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``(doc_id, findings)``: all spans of each text by start and kind, with the network's probability."""
    sent = docs.sparkSession.sparkContext.broadcast(net or fit(docs))
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("learned", pa.bool_()), ("probability", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            rows = [
                [{"kind": KINDS[k], "start": a, "end": b, "learned": k == LEARNED, "probability": p} for a, k, b, p in spans]
                for spans in _searched(batch.column(1), sent.value)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], names=["doc_id", "findings"])

    return _documents(docs).mapInArrow(search, f"doc_id long, findings array<{FINDING}>")


def digests(found: DataFrame) -> DataFrame:
    """Numbers of base findings, their digest, and all spans as ``kind:start:end``."""
    base = F.filter("findings", lambda s: ~s["learned"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda kind: F.filter("findings", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS[:LEARNED]]
    return found.select("doc_id", *counts, F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("findings")).alias("spans"))


def redact(docs: DataFrame, net: Network | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with all spans of ``text`` replaced; spans that overlap become one mark; null stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(net or fit(docs))

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            parts, end = [], 0
            for a, _, b, _ in find_in(text, sent.value) if text is not None else ():
                if a >= end:
                    parts += [text[end:a], mark]
                end = max(end, b)
            out.append(text if text is None else "".join([*parts, text[end:]]))
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", cleaned("text"))

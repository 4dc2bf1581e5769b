"""The work on one part of a collection: a sweep of collapsed Gibbs sampling, and variational steps.

Numpy only, on the documents of one task; ``topic_tables`` deals the documents out and merges the counts.
"""

from __future__ import annotations

import numpy as np

# Documents sampled side by side, and tokens of a document that are sampled one after the other.
LANES, MOST_LANES = 256, 1024
STRETCH = 512
# With many documents, a group has this share of the lanes.
LANE_SHARE = 0.25
# Pairs of a document and a term whose weights are held at once, and bounds of the variational steps.
ENTRIES = 1 << 18
# Up to so many topics a token is drawn from the weights of all of them, beyond from three buckets.
DENSE_TOPICS = 64
MAX_STEPS = 50
TOLERANCE = 1e-3
LEFT_OUT = 0.25


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of the log of the gamma function, for positive values."""
    x = np.array(x, dtype=np.float64)
    out = np.zeros_like(x)
    for _ in range(6):
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def topic_counts(keys: np.ndarray, topics: np.ndarray, size: int, num_topics: int) -> np.ndarray:
    """How often each key (a term, a document) has each topic."""
    return np.bincount(keys * num_topics + topics, minlength=size * num_topics).reshape(size, num_topics)


class Lanes:
    """Stretches of documents that are sampled at the same time, each with the topics of its document.

    The topics a document has are kept as a list per lane, so that a token costs as many steps as its
    document has topics, and not as many as there are topics.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        rows, cols = np.nonzero(counts)
        self.sizes = np.bincount(rows, minlength=len(counts))
        before = np.cumsum(self.sizes) - self.sizes
        self.listed = np.zeros(counts.shape, dtype=np.int64)
        self.listed[rows, np.arange(len(rows)) - before[rows]] = cols
        self.has = counts > 0
        self.width = max(1, int(self.sizes.max(initial=0)))

    def topics(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The topics of the first ``n`` lanes and their counts; places beyond a list count 0."""
        own = self.listed[:n, : self.width]
        counts = np.take_along_axis(self.counts[:n], own, axis=1)
        return own, np.where(np.arange(self.width) < self.sizes[:n, None], counts, 0)

    def add(self, lane: np.ndarray, topic: np.ndarray) -> None:
        self.counts[lane, topic] += 1
        fresh = ~self.has[lane, topic]
        if fresh.any():
            lane, topic = lane[fresh], topic[fresh]
            self.has[lane, topic] = True
            self.listed[lane, self.sizes[lane]] = topic
            self.sizes[lane] += 1
            self.width = max(self.width, int(self.sizes[lane].max()))


class WordBucket:
    """``alpha * count / total`` over the topics that each word of a group has, summed up for drawing."""

    def __init__(self, counts: np.ndarray, totals: np.ndarray, alpha: np.ndarray):
        self.num_topics = counts.shape[1]
        rows, self.topics = np.nonzero(counts)
        weights = alpha[self.topics] * counts[rows, self.topics] / totals[self.topics]
        self.passed = np.concatenate(([0.0], np.cumsum(weights)))
        self.keys = rows * self.num_topics + self.topics
        self.bounds = np.searchsorted(rows, np.arange(len(counts) + 1))

    def place(self, word: np.ndarray, topic: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, word * self.num_topics + topic)

    def mass(self, word: np.ndarray) -> np.ndarray:
        return self.passed[self.bounds[word + 1]] - self.passed[self.bounds[word]]

    def draw(self, word: np.ndarray, own: np.ndarray, weight: np.ndarray, less: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """The topic at ``mass`` of each word, when the entry at ``own`` weighs only ``weight``, ``less`` less."""
        x = self.passed[self.bounds[word]] + mass
        x = np.where(x >= self.passed[own] + weight, x + less, x)
        at = np.searchsorted(self.passed, x, side="right") - 1
        return self.topics[np.clip(at, self.bounds[word], self.bounds[word + 1] - 1)]


def _stretches(bounds: np.ndarray, stretch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, first, length)`` of all stretches, longest first."""
    sizes = np.diff(bounds)
    number = -(-sizes // stretch)
    document = np.repeat(np.arange(len(sizes)), number)
    within = np.arange(len(document)) - np.repeat(np.cumsum(number) - number, number)
    first = bounds[document] + within * stretch
    length = np.minimum(stretch, bounds[document + 1] - first)
    order = np.argsort(-length, kind="stable")
    return document[order], first[order], length[order]


def gibbs_sweep(
    codes: np.ndarray,
    bounds: np.ndarray,
    topics: np.ndarray,
    counts: np.ndarray,
    totals: np.ndarray,
    alpha: np.ndarray,
    beta: float,
    num_terms: int,
    random: np.random.Generator,
    lanes: int | None = None,
    stretch: int = STRETCH,
) -> None:
    """Draw a new topic for every token, given the topics of all other tokens.

    ``codes`` and ``topics`` are those of all tokens, ``bounds`` the offsets of the documents in them,
    ``counts`` the tokens by term and topic and ``totals`` by topic; ``topics``, ``counts`` and ``totals``
    are changed. The weight of topic k is ``(n_dk + alpha_k) (n_wk + beta) / (n_k + V beta)`` without the
    token itself; with many topics it is drawn from three buckets: the topics of the document, those of the
    word, and all topics for the prior. Documents of a group are drawn side by side and see each other's words
    when the group is done; so do the stretches of a long document.
    """
    num_topics = len(alpha)
    prior = num_terms * beta
    document, first, length = _stretches(bounds, stretch)
    lanes = lanes or int(np.clip(len(document) * LANE_SHARE, LANES, MOST_LANES))
    for low in range(0, len(document), lanes):
        group = slice(low, low + lanes)
        start, size = first[group], length[group]
        own_docs, lane_doc = np.unique(document[group], return_inverse=True)
        sizes = bounds[own_docs + 1] - bounds[own_docs]
        at = np.repeat(bounds[own_docs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        owners = np.repeat(np.arange(len(own_docs)), sizes)
        in_lane = topic_counts(owners, topics[at], len(own_docs), num_topics)[lane_doc]
        tokens = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        before = topics[tokens].copy()
        all_totals = totals + prior
        draw = _draw_dense if num_topics <= DENSE_TOPICS else _draw_sparse
        draw(codes, topics, counts, all_totals, alpha, beta, start, size, tokens, in_lane, random)
        after = topics[tokens]
        moved = before != after
        _move(counts, codes[tokens[moved]], before[moved], after[moved])
        totals += np.bincount(after, minlength=num_topics) - np.bincount(before, minlength=num_topics)


def _move(counts: np.ndarray, codes: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
    """Tokens of ``codes`` leave topics ``before`` for ``after``; many of them are counted first."""
    if 8 * len(codes) < counts.size:
        np.subtract.at(counts, (codes, before), 1)
        np.add.at(counts, (codes, after), 1)
    else:
        counts -= topic_counts(codes, before, *counts.shape)
        counts += topic_counts(codes, after, *counts.shape)


def _draw_dense(
    codes: np.ndarray,
    topics: np.ndarray,
    counts: np.ndarray,
    all_totals: np.ndarray,
    alpha: np.ndarray,
    beta: float,
    start: np.ndarray,
    size: np.ndarray,
    tokens: np.ndarray,
    in_lane: np.ndarray,
    random: np.random.Generator,
) -> None:
    """New topics of a group of stretches, token by token, from the weights of all topics.

    Lanes are longest first, so the tokens of a step are those of the first lanes. What does not change within
    the group is worked out for all its tokens at once, in the order in which they are drawn."""
    num_topics = len(alpha)
    steps = tokens - np.repeat(start, size)
    order = np.argsort(steps.astype(np.uint16) if size[0] < 1 << 16 else steps, kind="stable")
    ends = np.cumsum(np.bincount(steps))
    place = tokens[order]
    code, old = codes[place], topics[place]
    without = ((counts[code, old] - 1 + beta) / (all_totals[old] - 1)).astype(np.float32)
    if len(code) < len(counts):
        words, code = np.unique(code, return_inverse=True)
        counts = counts[words]
    phi = ((counts + beta) / all_totals).astype(np.float32)
    in_doc = in_lane.astype(np.float32)
    prior = np.tile(alpha.astype(np.float32), (len(size), 1))
    # Places of a lane's topics in the flat tables of a step.
    every = np.arange(len(size)) * num_topics
    own = np.repeat(np.arange(len(size)) * num_topics, size)[order] + old
    u = random.random(len(code), dtype=np.float32)
    new = np.empty(len(code), dtype=np.int8)
    weights, both = np.empty_like(prior), np.empty_like(prior)
    sums = np.empty(len(size) * num_topics, dtype=np.float32)
    reached = np.empty(len(size) * num_topics, dtype=bool)
    flat, flat_doc = weights.reshape(-1), in_doc.reshape(-1)
    low = 0
    for high in ends.tolist():
        n, at = high - low, own[low:high]
        flat_doc[at] -= 1
        np.take(phi, code[low:high], axis=0, out=weights[:n], mode="clip")
        flat[at] = without[low:high]
        weights[:n] *= np.add(in_doc[:n], prior[:n], out=both[:n])
        passed = sums[: n * num_topics].reshape(num_topics, n)
        np.copyto(passed, weights[:n].T)
        for k in range(1, num_topics):
            passed[k] += passed[k - 1]
        below = np.less_equal(passed, u[low:high] * passed[-1], out=reached[: n * num_topics].reshape(num_topics, n))
        drawn = np.minimum(np.add.reduce(below.view(np.int8), axis=0, dtype=np.int8), num_topics - 1, out=new[low:high])
        flat_doc[every[:n] + drawn] += 1
        low = high
    topics[place] = new


def _draw_sparse(
    codes: np.ndarray,
    topics: np.ndarray,
    counts: np.ndarray,
    all_totals: np.ndarray,
    alpha: np.ndarray,
    beta: float,
    start: np.ndarray,
    size: np.ndarray,
    tokens: np.ndarray,
    in_lane: np.ndarray,
    random: np.random.Generator,
) -> None:
    """New topics of a group of stretches, token by token, from three buckets."""
    num_topics = len(alpha)
    lane = Lanes(in_lane)
    words, local = np.unique(codes[tokens], return_inverse=True)
    word_at = np.empty(size.sum(), dtype=np.int64)
    word_at[:] = local
    lane_start = np.cumsum(size) - size
    bucket = WordBucket(counts[words], all_totals, alpha)
    smooth = alpha * beta / all_totals
    smooth_passed = np.cumsum(smooth)

    for step in range(int(size[0])):
        n = int(np.searchsorted(-size, -step, side="left"))
        index = np.arange(n)
        place = start[:n] + step
        word = word_at[lane_start[:n] + step]
        code, old = codes[place], topics[place]
        lane.counts[index, old] -= 1

        own, in_doc = lane.topics(n)
        self_count = own == old[:, None]
        phi = (counts[code[:, None], own] - self_count + beta) / (all_totals[own] - self_count)
        doc_passed = np.cumsum(in_doc * phi, axis=1)
        doc_mass = doc_passed[:, -1]

        entry = bucket.place(word, old)
        weight = alpha[old] * (counts[code, old] - 1) / (all_totals[old] - 1)
        less = bucket.passed[entry + 1] - bucket.passed[entry] - weight
        word_mass = bucket.mass(word) - less
        more = alpha[old] * beta / (all_totals[old] - 1) - smooth[old]

        u = random.random(n) * (doc_mass + word_mass + smooth_passed[-1] + more)
        from_doc = own[index, np.minimum((doc_passed <= u[:, None]).sum(axis=1), own.shape[1] - 1)]
        rest = u - doc_mass
        from_word = bucket.draw(word, entry, weight, less, rest)
        rest_smooth = rest - word_mass
        from_prior = np.minimum(np.searchsorted(smooth_passed, rest_smooth, side="right"), num_topics - 1)
        from_prior = np.where(rest_smooth >= smooth_passed[-1], old, from_prior)
        new = np.where(u < doc_mass, from_doc, np.where(rest < word_mass, from_word, from_prior))

        lane.add(index, new)
        topics[place] = new


def alpha_statistics(bounds: np.ndarray, topics: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Sums over documents for a step of Minka's fixed point: one per topic, and one for all of them."""
    num_topics = len(alpha)
    sizes = np.diff(bounds)
    owners = np.repeat(np.arange(len(sizes)), sizes)
    if len(sizes) * num_topics <= 4 * len(topics):
        by_key = np.bincount(owners * num_topics + topics)
        keys = np.flatnonzero(by_key)
        counts = by_key[keys]
    else:
        keys, counts = np.unique(owners * num_topics + topics, return_counts=True)
    own = keys % num_topics
    above = np.bincount(own, weights=digamma(counts + alpha[own]) - digamma(alpha)[own], minlength=num_topics)
    return np.append(above, (digamma(sizes + alpha.sum()) - digamma(alpha.sum())).sum())


def next_alpha(alpha: np.ndarray, statistics: np.ndarray, least: float = 1e-5) -> np.ndarray:
    return np.maximum(alpha * statistics[:-1] / max(statistics[-1], 1e-12), least)


def _expected(gamma: np.ndarray) -> np.ndarray:
    return np.exp(digamma(gamma) - digamma(gamma.sum(axis=1, keepdims=True)))


def _settle(weights: np.ndarray, n: np.ndarray, sizes: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """The topic weights of documents with ``sizes`` entries each, whose ``weights`` are by topic and entry; a
    document that has settled stays, so that no document's result depends on others.

    Documents of about one size stand side by side, filled up to a width that depends on their own size only,
    so that a step is two products of matrices. Settled ones are left out of a width once they are a share of
    ``LEFT_OUT`` together: leaving out copies all others."""
    starts = np.cumsum(sizes) - sizes
    gamma = alpha + np.add.reduceat(n, starts)[:, None] / len(alpha)
    unit = 1 << np.maximum(np.frexp(sizes)[1].astype(np.int64) - 4, 0)
    widths = -(-sizes // unit) * unit
    blocks = []
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        entry = np.arange(width)
        at = np.minimum(entry, sizes[own, None] - 1) + starts[own, None]
        table = np.ascontiguousarray(weights[:, at.ravel()].reshape(len(alpha), len(own), width).swapaxes(0, 1))
        blocks.append((own, table, np.where(entry < sizes[own, None], n[at], 0.0)))
    going, theta = np.ones(len(sizes), dtype=bool), np.empty_like(gamma)
    for _ in range(MAX_STEPS):
        active = np.flatnonzero(going)
        theta[active] = _expected(gamma[active])
        before, left = gamma.copy(), []
        for own, table, count in blocks:
            live = going[own]
            kept = np.count_nonzero(live)
            if not kept:
                continue
            if kept < (1 - LEFT_OUT) * len(own):
                own, table, count, live = own[live], table[live], count[live], live[live]
            left.append((own, table, count))
            mine = theta[own]
            share = np.matmul(mine[:, None, :], table)[:, 0]
            share += 1e-100
            np.divide(count, share, out=share)
            new = np.matmul(table, share[:, :, None])[:, :, 0]
            new *= mine
            new += alpha
            gamma[own[live]] = new[live]
        blocks = left
        going &= np.abs(gamma - before).mean(axis=1) >= TOLERANCE
        if not going.any():
            break
    return gamma


def variational(
    codes: np.ndarray,
    n: np.ndarray,
    bounds: np.ndarray,
    weights: np.ndarray,
    alpha: np.ndarray,
    statistics: np.ndarray | None = None,
    times: np.ndarray | None = None,
) -> np.ndarray:
    """The topic weights of each document (row), given its distinct terms, their counts, and how likely each
    term is in each topic. Expected counts by term and topic are added to ``statistics``, those of a document
    ``times`` times. Documents without terms have ``alpha``."""
    num_topics = len(alpha)
    out = np.tile(alpha.astype(np.float64), (len(bounds) - 1, 1))
    filled = np.flatnonzero(np.diff(bounds))
    cuts = np.flatnonzero(np.diff(bounds[filled] // ENTRIES)) + 1
    for rows in np.split(filled, cuts):
        if not len(rows):
            continue
        low, high = bounds[rows[0]], bounds[rows[-1] + 1]
        own, count, sizes = codes[low:high], n[low:high].astype(np.float64), np.diff(bounds)[rows]
        table = weights[own]
        gamma = _settle(table.T, count, sizes, alpha)
        out[rows] = gamma
        if statistics is not None:
            theta = _expected(gamma)[np.repeat(np.arange(len(rows)), sizes)]
            shared = table * theta
            shared *= (count / (shared.sum(axis=1) + 1e-100))[:, None]
            if times is not None:
                shared *= np.repeat(times[rows], sizes)[:, None]
            add_by_code(statistics, own, shared)
    return out


def add_by_code(sums: np.ndarray, codes: np.ndarray, rows: np.ndarray) -> None:
    """Add each row to the sums of its code; costs what the rows cost, however many codes there are."""
    seen, owner = np.unique(codes, return_inverse=True)
    own = [np.bincount(owner, weights=rows[:, k], minlength=len(seen)) for k in range(rows.shape[1])]
    sums[seen] += np.stack(own, axis=1)

"""Periodic runs: stretches of words that repeat a few words over and over, and texts without the repeats.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are equal) that no neighbouring
word extends, at least ``MIN_WORDS`` words and ``MIN_PERIODS`` periods long.

Words are read from left to right. Each word's earlier occurrences increment the match lengths of their
lags (diagonals of the text against itself); a diagonal that a word does not increment ends there and emits
its run at once if it is long enough. So that frequent words do not open a diagonal to each of their earlier
occurrences, the occurrences are those of a word *with the words before it*: for widths 1, 2, 4 ..., of the
width's words that end here, the nearest earlier occurrence counts, if its lag is above half the width and at
most the width. This is exact for three periods and more: within a run of smallest period ``q`` the ``w``
words before any place, ``w >= q``, have their nearest earlier occurrence ``q`` words back (a nearer one
would make a divisor of ``q`` a period), a match of ``w < 2 q`` words fits in, and a lag that passes has no
smaller period for the same reason. Each place opens one diagonal per width at most, and only places whose
words occur twice in the document are looked at again at the next width.

A null or empty text has no words and no runs. Words are told apart exactly. Repeated rows give equal
results and an empty table an empty one. Only ``doc_id`` and ``text`` are read, so other columns may have any
name. Time grows with the words times the logarithm of the longest repeat, whatever the words; memory with
the longest text and about 4 MB of other texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.text import pieces

MIN_WORDS = 24
MIN_PERIODS = 3
PIECE_BYTES = 4 << 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column, and the offsets of its rows in them."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat, bounds = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    kept = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(kept)))
    return flat.filter(pa.array(kept)), before[bounds - bounds[0]]


def word_numbers(words: pa.Array) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def occurrences(numbers: np.ndarray, rows: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(place, lag, width)`` of the earlier occurrences that count, ordered by place and lag.

    ``rows`` holds the document of each word and ``begins`` where it starts.
    """
    none = np.zeros(0, dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(none, none, none)]
    # The name of the words that end at a place: equal within a document if the words are.
    names = np.full(len(numbers), -1, dtype=np.int64)
    places = np.arange(len(numbers))
    keys = rows * (int(numbers.max()) + 1) + numbers if len(numbers) else none
    width = 1
    while len(places):
        order = np.argsort(keys, kind="stable")
        in_order = keys[order]
        again = np.zeros(len(order), dtype=bool)
        again[1:] = in_order[1:] == in_order[:-1]
        at = places[order]
        lags = at[1:] - at[:-1]
        counts = again[1:] & (2 * lags > width) & (lags <= width)
        here, own = at[1:][counts], lags[counts]
        found.append((here, own, np.full(len(here), width)))
        # Words that occur once cannot be the end of words that occur twice.
        twice = again.copy()
        twice[:-1] |= again[1:]
        names[:] = -1
        names[at[twice]] = (np.cumsum(~again) - 1)[twice]
        places = np.sort(at[twice])
        places = places[places - width >= begins[places]]
        places = places[names[places - width] >= 0]
        keys = names[places - width] * len(numbers) + names[places]
        width *= 2
    place, lag, widths = (np.concatenate(parts) for parts in zip(*found, strict=True))
    order = np.lexsort((lag, place))
    return place[order], lag[order], widths[order]


def runs_of(place: list[int], lag: list[int], width: list[int], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> Iterator[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of a text, from its occurrences in the order of their places."""
    active: dict[int, int] = {}
    last = -2

    def ended(matched: dict[int, int]) -> Iterator[tuple[int, int, int]]:
        for q, length in matched.items():
            if length + q >= max(min_words, min_periods * q):
                yield last - length - q + 1, length + q, q

    at, size = 0, len(place)
    while at < size:
        here = place[at]
        if here != last + 1:
            yield from ended(active)
            active = {}
        now: dict[int, int] = {}
        while at < size and place[at] == here:
            # A diagonal opens with as many matches as its occurrence has words.
            now[lag[at]] = active.pop(lag[at], width[at] - 1) + 1
            at += 1
        yield from ended(active)
        active, last = now, here
    yield from ended(active)


def find_in(words: pa.Array, bounds: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """The runs of each document, by start and period; ``bounds`` are the documents' offsets in ``words``."""
    if min_words < 1 or min_periods < 3:
        raise ValueError("a run has one word at least and three periods")
    sizes = np.diff(bounds)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    place, lag, width = occurrences(word_numbers(words), rows, np.repeat(bounds[:-1], sizes))
    found: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    first = np.searchsorted(place, bounds)
    for row in np.flatnonzero(np.diff(first)).tolist():
        own = slice(first[row], first[row + 1])
        at = (place[own] - bounds[row]).tolist()
        found[row] = sorted(runs_of(at, lag[own].tolist(), width[own].tolist(), min_words, min_periods))
    return found


def repeated(runs: list[list[tuple[int, int, int]]], bounds: np.ndarray) -> np.ndarray:
    """Which words stand in a run after its first period."""
    change = np.zeros(int(bounds[-1]) + 1, dtype=np.int64)
    for begin, own in zip(bounds.tolist(), runs, strict=False):
        for start, length, period in own:
            change[begin + start + period] += 1
            change[begin + start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``: the runs of each text by start and period, and the words that
    are left when each run keeps its first period, joined by one space."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, PIECE_BYTES):
            words, bounds = split_words(batch.column(1))
            runs = find_in(words, bounds, min_words, min_periods)
            kept = ~repeated(runs, bounds)
            left = np.concatenate(([0], np.cumsum(kept)))[bounds]
            lists = pa.LargeListArray.from_arrays(pa.array(left), words.filter(pa.array(kept)))
            columns = list(zip(*(run for own in runs for run in own), strict=True)) or [[], [], []]
            fields = [pa.array(values, pa.int64()) for values in columns]
            ends = np.concatenate(([0], np.cumsum([len(own) for own in runs]))).astype(np.int32)
            structs = pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(bounds)),
                    pa.ListArray.from_arrays(pa.array(ends), structs),
                    pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return read.mapInArrow(search, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period; ties go to the smallest start, then period."""

    def order(a: Column, b: Column) -> Column:
        return F.signum(b["length"] * a["period"] - a["length"] * b["period"]).cast("int")

    # Runs come by start and period, and the sort keeps the order of equals.
    return F.get(F.array_sort(runs, order), F.lit(0))


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with a tail of repeats in every tenth text, by the checksum of the id.

    With ``h`` the CRC-32 of the decimal id and ``g = h // 10``, a text of ``n`` words whose ``h`` ends in 0
    goes on from word ``a = g % n`` with its next ``1 + (n - a) // (3 + g % 8)`` words over and over. Rows
    without an id stay as they are.
    """
    checksum = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g = F.floor(checksum / 10)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    tail = F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1
    again = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")),
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(checksum % 10 == 0, words).alias("words"), g.alias("g"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", tail)
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    best = found.withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    sha = lambda column: F.sha2(column.cast("binary"), 256)
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        sha(F.array_join(lines, "")).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
    )

"""Fill-in-the-middle: cut texts at token bounds found in a compressed set of positions.

The units of a text are runs of ASCII letters and all other single code points. The positions after 0, 1,
2 ... units are a ``BoundarySet``: blocks of 65,536 positions, each held as a sorted array, a bitmap or
runs, whichever is smallest, next to the number of positions before each block. The position after ``k``
units is found by a search in these numbers and a selection within one block, so both cuts of a text cost
two look-ups, and a set takes 8 KB for 65,536 code points at most however long the text is.

The cuts, and the form of the result, come from the SHA-256 of a seed and the document's id:

- ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
- ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
- ``plain``: the text as it is; texts that are empty or hold a mark are always plain

A null text is empty. Rows without an id are cut by the digest of an empty id, and rows with equal ids and
texts are cut alike. Only ``doc_id`` and ``text`` are read, so other columns may have any name; an empty
table gives an empty result. Whole texts are cut: work is in proportion to the length, memory to the
length of the longest text and about 8 MB of other texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.text import batch_bytes, pieces

BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS
WORDS = BLOCK // 64
ARRAY, BITMAP, RUNS = "array", "bitmap", "runs"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED = 1
# Of 100 texts, those that are cut, and of 100 cut ones, those with the suffix first.
CUT_SHARE = 90
SPM_SHARE = 20

IS_LETTER = np.zeros(256, dtype=bool)
IS_LETTER[ord("A") : ord("Z") + 1] = IS_LETTER[ord("a") : ord("z") + 1] = True


@dataclass(frozen=True)
class Block:
    """The positions of one block, by their low 16 bits: ``size`` of them, in the smallest form."""

    kind: str
    size: int
    data: np.ndarray

    @classmethod
    def of(cls, low: np.ndarray) -> Block:
        """From ascending, distinct low bits."""
        starts = np.flatnonzero(np.diff(low.astype(np.int32), prepend=-2) != 1)
        sizes = {RUNS: 4 * len(starts), ARRAY: 2 * len(low), BITMAP: 8 * WORDS}
        kind = min(sizes, key=sizes.get)
        if kind == RUNS:
            # A run is its first position and the number of positions of the block before it.
            data = np.stack((low[starts], starts.astype(np.uint16)))
        elif kind == ARRAY:
            data = low.astype(np.uint16)
        else:
            bits = np.zeros(BLOCK, dtype=np.uint8)
            bits[low] = 1
            data = np.packbits(bits, bitorder="little").view("<u8")
        return cls(kind, len(low), data)

    @property
    def n_bytes(self) -> int:
        return self.data.nbytes

    def select(self, k: int) -> int:
        """The low bits of position number ``k``, from 0."""
        if self.kind == ARRAY:
            return int(self.data[k])
        if self.kind == RUNS:
            first, before = self.data
            run = int(np.searchsorted(before, k, side="right")) - 1
            return int(first[run]) + k - int(before[run])
        passed = np.cumsum(np.bitwise_count(self.data), dtype=np.int64)
        word = int(np.searchsorted(passed, k, side="right"))
        k -= int(passed[word - 1]) if word else 0
        bits = np.unpackbits(self.data[word : word + 1].view(np.uint8), bitorder="little")
        return 64 * word + int(np.flatnonzero(bits)[k])

    def positions(self) -> np.ndarray:
        if self.kind == ARRAY:
            return self.data.astype(np.int64)
        if self.kind == RUNS:
            first, before = self.data.astype(np.int64)
            lengths = np.diff(before, append=self.size)
            return np.repeat(first - before, lengths) + np.arange(self.size)
        return np.flatnonzero(np.unpackbits(self.data.view(np.uint8), bitorder="little"))


class BoundarySet:
    """An ascending set of positions in blocks, built from pieces, with selection by number."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.blocks: list[Block] = []
        self.passed: list[int] = [0]
        self._tail = np.zeros(0, dtype=np.int64)
        self._numbers: np.ndarray | None = None

    @classmethod
    def of(cls, positions: np.ndarray) -> BoundarySet:
        found = cls()
        found.extend(positions)
        return found.close()

    def extend(self, positions: np.ndarray) -> None:
        """Add ascending positions, all larger than those added before."""
        if not len(positions):
            return
        rest = np.concatenate((self._tail, positions))
        keys = rest >> BLOCK_BITS
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for part in np.split(rest, cuts)[:-1]:
            self._add(part)
        self._tail = rest[cuts[-1] :] if len(cuts) else rest

    def close(self) -> BoundarySet:
        if len(self._tail):
            self._add(self._tail)
            self._tail = self._tail[:0]
        self._numbers = np.array(self.passed, dtype=np.int64)
        return self

    def _add(self, positions: np.ndarray) -> None:
        self.keys.append(int(positions[0]) >> BLOCK_BITS)
        self.blocks.append(Block.of((positions & (BLOCK - 1)).astype(np.uint16)))
        self.passed.append(self.passed[-1] + len(positions))

    def __len__(self) -> int:
        return self.passed[-1]

    def select(self, k: int) -> int:
        """Position number ``k``, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self._numbers, k, side="right")) - 1
        return (self.keys[at] << BLOCK_BITS) + self.blocks[at].select(k - self.passed[at])

    def positions(self) -> np.ndarray:
        parts = [(key << BLOCK_BITS) + block.positions() for key, block in zip(self.keys, self.blocks, strict=True)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    @property
    def n_bytes(self) -> int:
        return sum(block.n_bytes for block in self.blocks)


def boundaries(data: np.ndarray) -> BoundarySet:
    """Positions in code points after 0, 1, 2 ... units of a text in UTF-8, a stretch at a time."""
    found = BoundarySet()
    points, after_letter = 0, False
    for low in range(0, len(data), 1 << 20):
        piece = data[low : low + (1 << 20)]
        letter = IS_LETTER[piece]
        lead = (piece & 0xC0) != 0x80
        before = np.empty_like(letter)
        before[0], before[1:] = after_letter, letter[:-1]
        starts = lead & ~(letter & before)
        number = np.cumsum(lead)
        # A unit starts where the one before it ends; the first one starts at position 0.
        found.extend(number[starts] - 1 + points)
        points += int(number[-1])
        after_letter = bool(letter[-1])
    found.extend(np.array([points]))
    return found.close()


def choices(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that decide what happens to a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def transform(text: str, data: np.ndarray, doc_id: int | None, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """``(n, form, prefix_chars, middle_chars, output)`` of a text, given with its bytes."""
    bounds = boundaries(data)
    n = len(bounds) - 1
    h1, h2, h3, h4 = choices(doc_id, seed)
    if not text or h3 % 100 >= CUT_SHARE or any(mark in text for mark in MARKS):
        return n, PLAIN, None, None, text
    first, second = (bounds.select(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < SPM_SHARE:
        form, output = SPM, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    else:
        form, output = PSM, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return n, form, first, second - first, output


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``: every text in its form."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            data, offsets = batch_bytes(batch.column(1))
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [
                transform(text, data[a:b], doc_id, seed)
                for doc_id, text, a, b in zip(ids, texts, offsets, offsets[1:], strict=False)
            ]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return read.mapInArrow(cut, schema)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from.

    No mark can start inside a part and end in the mark after it, as no mark ends with the beginning of
    another, so the marks cut the output into the parts that went in.
    """
    parts = F.split(output, "<[PSM]>", -1)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == PLAIN, output).when(form == PSM, F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def digests(cut: DataFrame) -> DataFrame:
    """The result of ``fill_in_middle`` with digests of outputs and of the texts restored from them."""
    sha = lambda column: F.sha2(column.cast("binary"), 256)
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("form"), F.col("output"))).alias("restored_sha256"),
    )

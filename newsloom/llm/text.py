"""Words of whole Arrow batches as 64-bit hashes, computed on the bytes of the batch at once.

A word is a run of bytes other than ``0x20`` and ``0x09`` to ``0x0D``. Hashes are the same in every
process. Two different words of a corpus share a hash with a probability of about the square of the
vocabulary over 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
# Bytes hashed at once; only a single longer word needs more.
PIECE = 1 << 17
BASE = np.uint64(0x5851F42D4C957F2D)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(256, dtype=np.uint64), 7)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        tables = []
        with np.errstate(over="ignore"):
            for factor in (BASE, inverse):
                table = np.full(size, factor, dtype=np.uint64)
                table[0] = 1
                tables.append(np.cumprod(table, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null rows are empty."""
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"", column.type) if pa.types.is_binary(column.type) else "")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column) or bounds[-1] == bounds[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; no word spans two rows."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    word = ~IS_SPACE[data]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    starts[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each ascending, disjoint span of ``data``."""
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            low = starts[first]
            last = max(first + 1, int(np.searchsorted(ends, low + PIECE, side="right")))
            piece = data[low : ends[last - 1]]
            power, inverse = _power_tables(len(piece) + 1)
            sums = np.empty(len(piece) + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(BYTE_VALUES[piece] * power[: len(piece)], dtype=np.uint64, out=sums[1:])
            s, e = starts[first:last] - low, ends[first:last] - low
            out[first:last] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
            first = last
    return mix(out)


def words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column, and the offsets of its rows in them."""
    data, offsets = batch_bytes(column)
    if lower:
        data = LOWER[data]
    starts, ends = word_bounds(data, offsets)
    return hash_spans(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each row; a shorter row is one run.

    Returns the hashes with repeats, in order, and the offsets of the rows in them.
    """
    sizes = np.diff(bounds)
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    out_bounds = np.concatenate(([0], np.cumsum(counts)))
    factors = mix(np.arange(width, dtype=np.uint64), 11) | np.uint64(1)
    with np.errstate(over="ignore"):
        runs = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
        for k in range(width):
            runs += hashes[k : k + len(runs)] * factors[k]
        first = np.repeat(bounds[:-1] - out_bounds[:-1], counts) + np.arange(out_bounds[-1])
        out = np.zeros(len(first), dtype=np.uint64)
        long_row = np.repeat(sizes >= width, counts)
        out[long_row] = runs[first[long_row]]
        for row in np.flatnonzero((sizes > 0) & (sizes < width)):
            own = hashes[bounds[row] : bounds[row + 1]]
            out[out_bounds[row]] = (own * factors[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out, 3), out_bounds


def pieces(batches, column: int, limit: int = 8 << 20):
    """Cut record batches so that a piece has about ``limit`` bytes of the text column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(batch_bytes(batch.column(column))[1])
        group = np.cumsum(sizes) // limit
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows])).tolist()
        for low, high in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(low, high - low)


def free_names(columns: list[str], *names: str) -> list[str]:
    """Names for columns that an operator adds, longer by underscores where a table has them already."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out

"""Places of words in a long list of terms, in memory that a task can hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of a word that are hashed, besides its length.
HASHED_BYTES = 64
FNV_START, FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def hashes(words: pa.Array) -> np.ndarray:
    """64 hashed bits of the length and first bytes of each word, for all words at once; a null is an empty word."""
    words = pc.fill_null(words.cast(pa.string()), "")
    _, offsets, data = words.buffers()
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    bounds = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, ranked = bounds[:-1][order], -sizes[order]
    out = FNV_START ^ sizes[order].astype(np.uint64)
    for place in range(min(int(sizes.max()), HASHED_BYTES)):
        n = int(np.searchsorted(ranked, -place, side="left"))
        out[:n] = (out[:n] ^ data[starts[:n] + place]) * FNV_PRIME
    found = np.empty_like(out)
    found[order] = out
    return found


class TermIndex:
    """Made once and sent to the tasks, so that a batch costs what its own words cost, however many terms
    there are. Words are found by hash and then compared; terms that share a hash are looked up by themselves."""

    def __init__(self, terms: pa.Array):
        self.terms = terms
        own = hashes(terms)
        self.places = np.argsort(own, kind="stable").astype(np.int32)
        self.hashes = own[self.places]
        same = np.zeros(len(own), dtype=bool)
        same[1:] = self.hashes[1:] == self.hashes[:-1]
        same[:-1] |= same[1:]
        self.shared = np.sort(self.places[same])

    def __len__(self) -> int:
        return len(self.terms)

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word among the terms, the first one if it is there twice; -1 if it is unknown or null."""
        coded = words.dictionary_encode()
        places = np.append(self._find(coded.dictionary), np.int64(-1))
        return places[pc.fill_null(coded.indices, len(places) - 1).to_numpy(zero_copy_only=False)]

    def _find(self, words: pa.Array) -> np.ndarray:
        out = np.full(len(words), -1, dtype=np.int64)
        if not len(words) or not len(self):
            return out
        own = hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, own), len(self) - 1)
        hits = np.flatnonzero(self.hashes[at] == own)
        candidates = self.places[at[hits]]
        equal = pc.equal(words.take(pa.array(hits)), self.terms.take(pa.array(candidates)))
        equal = pc.fill_null(equal, False).to_numpy(zero_copy_only=False)
        out[hits[equal]] = candidates[equal]
        if len(self.shared):
            among = pc.index_in(words, value_set=self.terms.take(pa.array(self.shared)))
            known = among.is_valid().to_numpy(zero_copy_only=False)
            out[known] = self.shared[among.drop_null().to_numpy()]
        return out

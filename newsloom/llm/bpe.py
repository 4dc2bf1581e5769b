"""Byte-level BPE: encode whole texts to ids and decode ids to bytes.

Words, as the tokenizer's pattern cuts them, are merged over a contiguous array of ranks: the array
holds a boundary per part and the rank of each part with the next one. The smallest rank is found by a
scan, its boundary is deleted and the two neighbouring ranks are looked up anew. The arrays of all new
words of one length are worked on together. A scan costs the length of the word, so words longer than
``SHORT`` bytes keep their ranks in a heap instead; the merges and so the ids are the same. Each Python
worker remembers the ids of words up to about ``CACHE_BYTES`` and starts afresh beyond that.

Nulls are empty texts. An empty text has no ids. Repeated rows give repeated results. Special tokens in
a text are matched, longest first, unless ``special_as_text`` is set.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.text import pieces

SHORT = 64
# A worker remembers words until they take about so many bytes; what an entry takes besides its bytes.
CACHE_BYTES = 24 << 20
ENTRY_BYTES = 150
GROUP = 1 << 21
MAX_FILE = 64 << 20
ID_SPAN = 1 << 31
NO_RANK = 1 << 60
# A space before another one or at the end; wider than the pattern's own idea of spaces.
ODD_SPACES = r" [\s\x0b\x1c-\x1f\x{85}\p{Z}]| \z"
# Fixed value: how the vocabulary's tokenizer cuts texts into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


def read_vocabulary(path: str) -> str:
    """The tokenizer file, read where the job starts; its size is checked."""
    with open(path, encoding="utf-8") as file:
        content = file.read(MAX_FILE + 1)
    if len(content) > MAX_FILE:
        raise ValueError(f"{path} has more than {MAX_FILE} characters, too many to send to every worker")
    return content


class ByteBpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, content: str, special_as_text: bool = False):
        spec = json.loads(content)
        model, alphabet = spec["model"], byte_alphabet()
        to_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.pieces = {i: to_bytes(token) for token, i in model["vocab"].items()}
        ids = {piece: i for i, piece in self.pieces.items()}
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = [[to_bytes(part) for part in merge] for merge in merges]
        self.pairs = {(ids[left], ids[right]): rank for rank, (left, right) in enumerate(merges)}
        self.merged = np.array([ids[left + right] for left, right in merges], dtype=np.int64)
        keys = np.array([left * ID_SPAN + right for left, right in self.pairs], dtype=np.int64)
        self.pair_keys, self.pair_ranks = np.sort(keys), np.array(list(self.pairs.values()))[np.argsort(keys)]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.marks = [] if special_as_text else sorted(self.special, key=len, reverse=True)
        self.split_marks = None
        if self.marks:
            self.split_marks = regex.compile("(" + "|".join(regex.escape(m) for m in self.marks) + ")")
        lengths = np.zeros(max(self.pieces) + 2, dtype=np.int64)
        for i, piece in self.pieces.items():
            lengths[i + 1] = len(piece)
        self.piece_starts = np.cumsum(lengths)
        self.piece_bytes = np.frombuffer(b"".join(self.pieces[i] for i in sorted(self.pieces)), np.uint8)
        self.pattern = regex.compile(WORD_PATTERN)
        # Ids of words met, four bytes each, and about how many bytes they take.
        self.words: dict[str, bytes] = {}
        self.cached = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string array, one after the other, and the offsets of the texts."""
        ids, counts, first = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else []
        while first < len(texts):
            done = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, done + GROUP, side="right")))
            found, bounds = self._encode_group(texts.slice(first, last - first))
            ids.append(found)
            counts.append(np.diff(bounds))
            first = last
        return np.concatenate(ids), np.cumsum(np.concatenate(counts))

    def _encode_group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cut the texts, look every distinct cutting up once and gather the ids by cutting.

        A space before a character that is no space always starts a new word of the pattern, so texts
        are cut at such spaces. Texts with longer runs of spaces or with special tokens are cut singly.
        """
        odd = pc.match_substring_regex(texts, ODD_SPACES)
        for mark in self.marks:
            odd = pc.or_(odd, pc.match_substring(texts, mark))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        bounds = plain.offsets.to_numpy().astype(np.int64)
        cuttings = plain.flatten().dictionary_encode()
        codes = cuttings.indices.to_numpy().astype(np.int64)
        names: list[str | int] = [" " + c for c in cuttings.dictionary.to_pylist()]
        # The first cutting of a text has no space before it.
        firsts = plain.flatten().take(pa.array(bounds[:-1])).dictionary_encode()
        codes[bounds[:-1]] = firsts.indices.to_numpy() + len(names)
        names += firsts.dictionary.to_pylist()
        for row in np.flatnonzero(odd)[::-1].tolist():
            own = self._cut(texts[row].as_py())
            at = bounds[row]
            codes = np.concatenate((codes[:at], len(names) + np.arange(len(own)), codes[at + 1 :]))
            bounds[row + 1 :] += len(own) - 1
            names += own
        flat, starts = self._look_up(names)
        sizes = np.diff(starts)[codes]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = flat[np.repeat(starts[codes] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[bounds]

    def _look_up(self, names: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct cuttings, one after the other, and their offsets; a number is itself an id."""
        words = self.words
        if self.cached > CACHE_BYTES:
            words.clear()
            self.cached = 0
        several = {c: self._pieces(c) for c in names if c not in words and c.__class__ is str}
        missing = sorted({w for found in several.values() for w in found} - words.keys(), key=len)
        for word, ids in zip(missing, self.merge([w.encode() for w in missing]), strict=True):
            words[word] = packed = np.array(ids, dtype="<u4").tobytes()
            self.cached += ENTRY_BYTES + len(word) + len(packed)
        lists = []
        for c in names:
            if c in words:
                lists.append(words[c])
            elif c.__class__ is str:
                lists.append(b"".join([words[w] for w in several[c]]))
            else:
                lists.append(c.to_bytes(4, "little"))
        flat = np.frombuffer(b"".join(lists), dtype="<u4").astype(np.int64)
        return flat, np.concatenate(([0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)) // 4)))

    def _pieces(self, cutting: str) -> Sequence[str]:
        """Words of the pattern; the two commonest forms, letters and letters with a mark, need no search."""
        if cutting[1:].isalpha() and (cutting[0] == " " or cutting[0].isalpha()):
            return (cutting,)
        if cutting[-1:] in (",", ".") and cutting[1:-1].isalpha() and (cutting[0] == " " or cutting[0].isalpha()):
            return cutting[:-1], cutting[-1]
        return self.pattern.findall(cutting)

    def _cut(self, text: str) -> list[str | int]:
        """Parts of a text that the pattern never joins, and the ids of special tokens between them."""
        out: list[str | int] = []
        for k, part in enumerate(self.split_marks.split(text) if self.split_marks else [text]):
            if k % 2:
                out.append(self.special[part])
                continue
            first = len(out)
            for cut in part.split(" "):
                if len(out) > first and (not cut or cut[0].isspace()):
                    out[-1] += " " + cut
                else:
                    out.append(" " + cut if len(out) > first else cut)
        return out

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words. Short words of one length are merged side by side."""
        out: list[list[int]] = [[]] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            if len(word) > SHORT:
                out[k] = self._merge_long([int(i) for i in self.byte_ids[np.frombuffer(word, np.uint8)]])
            elif word:
                by_size.setdefault(len(word), []).append(k)
        for size, rows in by_size.items():
            data = np.frombuffer(b"".join(words[k] for k in rows), np.uint8).reshape(len(rows), size)
            for where, ids in self._merge_short(self.byte_ids[data]):
                for k, found in zip(where.tolist(), ids.tolist(), strict=True):
                    out[rows[k]] = found
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * ID_SPAN + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)

    def _merge_short(self, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rank arrays of many words of one length, a row each. A row that is done leaves, and every
        other row loses one boundary per round, so the rows keep a common length."""
        rows = np.arange(len(parts))
        ranks = self._ranks(parts[:, :-1], parts[:, 1:])
        while len(rows):
            width = parts.shape[1]
            if width == 1:
                yield rows, parts
                return
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            done = least == NO_RANK
            if done.any():
                yield rows[done], parts[done]
                rows, parts, ranks, at, least = (x[~done] for x in (rows, parts, ranks, at, least))
            line = np.arange(len(rows))
            parts[line, at] = self.merged[least]
            keep = np.ones(parts.shape, dtype=bool)
            keep[line, at + 1] = False
            parts = parts[keep].reshape(len(rows), width - 1)
            keep = np.ones(ranks.shape, dtype=bool)
            keep[line, at] = False
            ranks = ranks[keep].reshape(len(rows), width - 2)
            for near in (at - 1, at):
                inside = (near >= 0) & (near < width - 2)
                i, j = line[inside], near[inside]
                ranks[i, j] = self._ranks(parts[i, j], parts[i, j + 1])

    def _rank(self, left: int, right: int) -> int:
        return self.pairs.get((left, right), NO_RANK)

    def _merge_long(self, parts: list[int]) -> list[int]:
        """One long word: the same merges, with the ranks in a heap instead of scanned."""
        size = len(parts)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        heap = [(r, i) for i in range(size - 1) if (r := self._rank(parts[i], parts[i + 1])) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            nxt = after[at]
            if parts[at] < 0 or nxt >= size or self._rank(parts[at], parts[nxt]) != rank:
                continue
            parts[at] = int(self.merged[rank])
            parts[nxt] = -1
            after[at] = after[nxt]
            if after[nxt] < size:
                before[after[nxt]] = at
                if (r := self._rank(parts[at], parts[after[at]])) != NO_RANK:
                    heapq.heappush(heap, (r, at))
            if before[at] >= 0 and (r := self._rank(parts[before[at]], parts[at])) != NO_RANK:
                heapq.heappush(heap, (r, before[at]))
        return [p for p in parts if p >= 0]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts whose ids stand one after the other; bytes that are no UTF-8 are replaced."""
        starts = self.piece_starts[ids]
        sizes = self.piece_starts[ids + 1] - starts
        ends = np.concatenate(([0], np.cumsum(sizes)))
        out = []
        first = 0
        while first + 1 < len(bounds):
            last = max(first + 1, int(np.searchsorted(ends[bounds], ends[bounds[first]] + GROUP, side="right")) - 1)
            a, b = bounds[first], bounds[last]
            at = np.repeat(starts[a:b] - ends[a:b], sizes[a:b]) + np.arange(ends[a], ends[b])
            data = self.piece_bytes[at].tobytes()
            cuts = (ends[bounds[first : last + 1]] - ends[a]).tolist()
            out += [data[i:j].decode("utf-8", errors="replace") for i, j in zip(cuts, cuts[1:], strict=False)]
            first = last
        return out


_codecs: dict[tuple[str, bool], ByteBpe] = {}


def codec(content: str, special_as_text: bool = False) -> ByteBpe:
    """One codec per worker and vocabulary."""
    key = (sha256(content.encode()).hexdigest(), special_as_text)
    if key not in _codecs:
        _codecs[key] = ByteBpe(content, special_as_text)
    return _codecs[key]


def _send(spark: SparkSession, vocabulary: str):
    return spark.sparkContext.broadcast(read_vocabulary(vocabulary))


def encode(docs: DataFrame, vocabulary: str, special_as_text: bool = False) -> DataFrame:
    """Add ``ids``, the token ids of ``text``, replacing a column of that name."""
    sent = _send(docs.sparkSession, vocabulary)

    @F.pandas_udf("array<int>")
    def ids_of(texts):
        bpe, out = codec(sent.value, special_as_text), []
        for piece in pieces([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])], 0, GROUP):
            ids, bounds = bpe.encode(piece.column(0))
            out += np.split(ids.astype(np.int32), bounds[1:-1])
        return pd.Series(out, index=texts.index, dtype=object)

    return docs.withColumn("ids", ids_of(F.coalesce(F.col("text"), F.lit(""))))


def decode(frame: DataFrame, vocabulary: str) -> DataFrame:
    """Add ``decoded``, the text of ``ids``; null ids are an empty text."""
    sent = _send(frame.sparkSession, vocabulary)

    @F.pandas_udf("string")
    def text_of(ids):
        lists = [np.zeros(0, np.int64) if x is None else np.asarray(x, dtype=np.int64) for x in ids]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
        return pd.Series(codec(sent.value).decode(np.concatenate([np.zeros(0, np.int64), *lists]), bounds), index=ids.index, dtype=object)

    return frame.withColumn("decoded", text_of("ids"))


def encode_decode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids (little-endian, 32 bits) and of the decoded text."""
    sent = _send(docs.sparkSession, vocabulary)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(sent.value)
        for batch in pieces(batches, 1, GROUP):
            ids, bounds = bpe.encode(batch.column(1))
            data, cuts = ids.astype("<u4"), bounds.tolist()
            of_ids = [sha256(data[i:j].tobytes()).hexdigest() for i, j in zip(cuts, cuts[1:], strict=False)]
            of_texts = [sha256(text.encode()).hexdigest() for text in bpe.decode(ids, bounds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(bounds)), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    texts = F.coalesce(F.col("text"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), texts).mapInArrow(digests, schema)

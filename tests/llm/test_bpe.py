import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from newsloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
CODEC = bpe.codec(bpe.read_vocabulary(PATH))
LIBRARY = Tokenizer.from_file(PATH)


def check(texts):
    ids, bounds = CODEC.encode(pa.array(texts, pa.string()))
    decoded = CODEC.decode(ids, bounds)
    for k, text in enumerate(texts):
        wanted = LIBRARY.encode(text, add_special_tokens=False).ids
        assert ids[bounds[k] : bounds[k + 1]].tolist() == wanted, text
        assert decoded[k] == LIBRARY.decode(wanted, skip_special_tokens=False)


def test_hard_texts():
    check(["", " ", "a<|endoftext|>b <|endoftext|>", "<|endoftext|>", "a  b", " a \n b", "\n a", "x  y  z"])
    check(["a  b\x1f c", "a \x1fc", "a \x85b", "  lead", "trail  ", "I'll've don't 'S ''s", "á ½ Ⅷ 😀", "\x00﻿"])


def test_long_words_and_texts():
    check(["x" * 3000, "ab" * 700 + " " + "日本" * 200, "hello " * 20_000, "a" * 65 + " " + "b" * 64])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab '\n\t.,1é日<|endoftx>  sS"), max_size=40), max_size=5))
def test_random_texts(texts):
    check(texts)


def test_invalid_bytes_are_replaced():
    ids = CODEC.byte_ids[np.array([0xC3, 0x28])]
    assert CODEC.decode(ids, np.array([0, 2])) == [LIBRARY.decode(ids.tolist())]


def test_special_tokens_as_text():
    plain = bpe.codec(bpe.read_vocabulary(PATH), special_as_text=True)
    ids, bounds = plain.encode(pa.array(["a<|endoftext|>b"]))
    assert 50256 not in ids and plain.decode(ids, bounds) == ["a<|endoftext|>b"]


def test_columns_and_round_trip(odd_documents, no_documents):
    out = bpe.decode(bpe.encode(odd_documents, PATH), PATH)
    assert set(odd_documents.columns) < set(out.columns)
    for row in out.collect():
        assert row["decoded"] == (row["text"] or "")
        assert row["ids"] == LIBRARY.encode(row["text"] or "", add_special_tokens=False).ids
    assert bpe.encode_decode_digests(no_documents, PATH).count() == 0


def test_query(documents):
    rows = {r["doc_id"]: r for r in bpe.encode_decode_digests(documents, PATH).collect()}
    for doc in documents.collect():
        ids = LIBRARY.encode(doc["text"] or "", add_special_tokens=False).ids
        row = rows[doc["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()

import re

import numpy as np
import pytest

from newsloom.llm import token_counts


def blocks_of(spark, files, size):
    rows = []
    for name, ids in files.items():
        data = np.array(ids, dtype="<u2").tobytes()
        rows += [(name, k, data[i : i + 2 * size]) for k, i in enumerate(range(0, len(data), 2 * size))]
    return spark.createDataFrame(rows, "file string, block long, payload binary")


def brute(files):
    out = []
    for name, ids in files.items():
        parts, count = [], 0
        for i in ids:
            if i == 0:
                parts.append(count)
                count = 0
            else:
                count += 1
        parts += [count] if count else []
        out += [(name, k, n) for k, n in enumerate(parts)]
    return sorted(out)


FILES = {
    "a": [5, 6, 0, 0, 7, 8, 9, 10, 11, 12, 13, 0, 1],
    "b": [0],
    "c": [3] * 25,
    "d": [],
    "e": [1, 0] * 9,
    "f": [0, 0, 0, 4, 4, 4, 4, 4, 4, 0],
}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
@pytest.mark.parametrize("group", [1, 2, 4096])
def test_equals_brute_force(spark, monkeypatch, size, group):
    monkeypatch.setattr(token_counts, "SUPERBLOCK", group)
    rows = token_counts.count_tokens(blocks_of(spark, FILES, size)).collect()
    assert sorted((r["file"], r["ordinal"], r["n_tokens"]) for r in rows) == brute(FILES)


def test_token_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    files = {f"t{k}.bin": rng.integers(0, 6, size=997 * k).tolist() for k in range(4)}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, dtype="<u2").tobytes())
    blocks = token_counts.read_token_files(spark, str(tmp_path), block_tokens=64)
    rows = token_counts.count_tokens(blocks).collect()
    assert sorted((r["file"].rpartition("/")[2], r["ordinal"], r["n_tokens"]) for r in rows) == brute(files)


def test_wide_ids_and_bad_blocks(spark):
    rows = [("a", 0, np.array([70_000, 9, 5], "<u4").tobytes()), ("a", 1, np.array([9], "<u4").tobytes()), ("b", 0, None)]
    blocks = spark.createDataFrame(rows, "file string, block long, payload binary")
    found = token_counts.count_tokens(blocks, separator=9, width=4).collect()
    assert sorted((r["ordinal"], r["n_tokens"]) for r in found) == [(0, 1), (1, 1)]
    with pytest.raises(Exception, match="cuts an id"):
        token_counts.count_tokens(spark.createDataFrame([("a", 0, b"abc")], "file string, block long, payload binary")).collect()


def test_documents(documents, odd_documents, no_documents):
    for docs in (documents, odd_documents):
        given = [(r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect()]
        rows = [tuple(r) for r in token_counts.document_token_counts(docs).collect()]
        assert sorted(rows, key=str) == sorted(given, key=str)
    assert token_counts.document_token_counts(no_documents).count() == 0


def test_documents_over_many_blocks(odd_documents):
    blocks, documents = token_counts.tokenise_to_blocks(odd_documents, block_tokens=1000)
    assert blocks.count() > 30
    rows = documents.join(token_counts.count_tokens(blocks), ["file", "ordinal"]).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows}[6] == 30_000

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import fill_middle as M


def ends_of(text):
    return [0] + [m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]


def bounds_of(text):
    return M.boundaries(np.frombuffer(text.encode(), dtype=np.uint8))


@pytest.mark.parametrize("text", ["", "a", "ab c", "é日本 x y12", "abc" * 100_000 + "1", "日" * 200_000, "a1" * 70_000, "a bc  " * 90_000, "word " * 300_000])
def test_boundaries_of_texts(text):
    found = bounds_of(text)
    wanted = ends_of(text)
    assert found.positions().tolist() == wanted
    for k in {0, len(wanted) // 3, len(wanted) // 2, len(wanted) - 1}:
        assert found.select(k) == wanted[k]


def test_boundaries_of_random_texts():
    random.seed(3)
    for _ in range(300):
        text = "".join(random.choices("ab é日1<", k=random.randint(0, 60)))
        assert bounds_of(text).positions().tolist() == ends_of(text)


def test_blocks_take_their_smallest_form_and_select_alike():
    generator = np.random.default_rng(1)
    few = np.sort(generator.choice(M.BLOCK, 300, replace=False))
    many = np.sort(generator.choice(M.BLOCK, 30_000, replace=False))
    runs = np.concatenate((np.arange(10, 20_000), np.arange(30_000, M.BLOCK)))
    for kind, low in ((M.ARRAY, few), (M.BITMAP, many), (M.RUNS, runs), (M.RUNS, np.arange(M.BLOCK))):
        block = M.Block.of(low.astype(np.uint16))
        assert (block.kind, block.size) == (kind, len(low))
        assert block.positions().tolist() == low.tolist()
        assert [block.select(k) for k in range(0, len(low), 97)] == low[::97].tolist()
        assert block.n_bytes <= 8192


def test_sets_over_many_blocks():
    positions = np.concatenate([np.arange(5), [70_000], np.arange(3 * M.BLOCK, 4 * M.BLOCK), [9 * M.BLOCK + 1]])
    found = M.BoundarySet()
    for part in np.array_split(positions, 7):
        found.extend(part)
    found.close()
    assert len(found) == len(positions)
    assert found.positions().tolist() == positions.tolist()
    assert [found.select(k) for k in range(0, len(positions), 1013)] == positions[::1013].tolist()
    for k in (-1, len(positions)):
        with pytest.raises(IndexError):
            found.select(k)


def test_a_set_is_much_smaller_than_its_text():
    assert bounds_of("word " * 300_000).n_bytes < 300_000 * 5 / 7


def brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or h[2] % 100 >= 90 or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_all_forms_against_brute_force(spark, odd_documents):
    random.seed(5)
    rows = [(i, "".join(random.choices(["word", " ", "é", "<", "S>", "P>", "M>", "12"], k=random.randint(0, 30)))) for i in range(400)]
    rows += [(500, "ends in <"), (501, "has <M> in it"), (502, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionAll(odd_documents.select("doc_id", "text"))
    cut = M.fill_in_middle(docs)
    found = cut.withColumn("back", M.restored(F.col("form"), F.col("output"))).collect()
    wanted = sorted([(i, *brute(i, t), t or "") for i, t in (tuple(r) for r in docs.collect())], key=repr)
    assert sorted([tuple(r) for r in found], key=repr) == wanted
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_odd_tables(spark, odd_documents, no_documents):
    clashing = odd_documents.withColumns({name: F.lit(1) for name in ("form", "output", "prefix_chars")})
    assert M.digests(M.fill_in_middle(clashing)).count() == odd_documents.count()
    empty = M.digests(M.fill_in_middle(no_documents))
    assert empty.count() == 0
    assert empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]

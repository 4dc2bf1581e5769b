import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsloom.llm import mixing


def brute_targets(sizes):
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(ordered)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        free = [s for s in ordered if s not in full]
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            return share | {s: 3 * sizes[s] for s in full}
        full |= above


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(docs):
    rows = mixing.mix_by_source(docs).collect()
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source").collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((g["doc_id"], size_of(g["text"])) for g in given)
    sizes = Counter()
    for g in given:
        sizes[g["source"]] += size_of(g["text"])
    wanted = brute_targets(dict(sizes))
    source = {(g["doc_id"], size_of(g["text"])): g["source"] for g in given}
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(wanted[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s, target in wanted.items():
        assert abs(taken[s] - target) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_by_source(docs).collect()))


def test_documents(documents):
    check(documents)


def test_excess_is_shared_again(spark):
    rows = [(i, "w " * (1 + i % 40), "big") for i in range(300)] + [(1000 + i, "w " * 3, f"s{i}") for i in range(6)]
    check(spark.createDataFrame([*rows, (2000, "w w", None)], "doc_id long, text string, source string"))


def test_odd_rows(spark, odd_documents, no_documents):
    rows = mixing.mix_by_source(odd_documents).collect()
    assert len(rows) == odd_documents.count() and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix_by_source(no_documents).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix_by_source(empty).collect()] == [0, 0]


def test_apply_mix_repeats_rows(spark, documents, odd_documents, no_documents):
    mixed = mixing.apply_mix(documents)
    assert mixed.columns == documents.columns
    taken = {r["doc_id"]: r for r in mixing.mix_by_source(documents).collect()}
    copies = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    for doc_id, row in taken.items():
        assert abs(copies[doc_id] * row["size"] - row["taken"]) <= row["size"] / 2 + 1e-9
    assert mixing.apply_mix(odd_documents).columns == odd_documents.columns
    assert mixing.apply_mix(no_documents).count() == 0


def brute_cost(capacities, members, quotas):
    """Least cost of the largest flow, by trying all ways to fill small quotas."""
    best = None
    arcs = [(p, s) for p in capacities for s in members[p]]
    for flow in itertools.product(*[range(min(3 * capacities[p], quotas[s]) + 1) for p, s in arcs]):
        into, out = Counter(), Counter()
        for (p, s), f in zip(arcs, flow, strict=True):
            into[p] += f
            out[s] += f
        if any(into[p] > 3 * c for p, c in capacities.items()) or any(out[s] > q for s, q in quotas.items()):
            continue
        cost = sum(sum(mixing.COPY_COSTS[i // capacities[p]] for i in range(into[p])) for p in capacities)
        best = min(best or (0, 10**9), (-sum(flow), cost))
    return best


@pytest.mark.parametrize("quotas", [{"a": 3, "b": 2}, {"a": 5, "b": 4}, {"a": 0, "b": 6}, {"a": 7, "b": 1}])
def test_flow_is_cheapest(quotas):
    capacities, members = {"A": 2, "AB": 1, "B": 1}, {"A": ["a"], "AB": ["a", "b"], "B": ["b"]}
    flows = mixing.route(capacities, members, quotas)
    into = Counter()
    for (p, _), f in flows.items():
        into[p] += f
    cost = sum(sum(mixing.COPY_COSTS[i // capacities[p]] for i in range(into[p])) for p in capacities)
    assert (-sum(flows.values()), cost) == brute_cost(capacities, members, quotas)


def test_overlapping_sources(spark):
    rows = [(i, "w w w", [["a"], ["b"], ["a", "b"], ["b", None]][i % 4]) for i in range(80)]
    docs = spark.createDataFrame([*rows, (99, "w", None), (98, "w", [])], "doc_id long, text string, in array<string>")
    chosen = mixing.mix(docs, F.col("in"))
    into = Counter()
    for (_, s), f in chosen.flows.items():
        into[s] += f
    for s, (_, target) in chosen.sources.items():
        assert into[s] <= round(target)
    by_pattern = {r["pattern"]: r["t"] for r in chosen.documents.groupBy("pattern").agg(F.sum("taken").alias("t")).collect()}
    for p, taken in by_pattern.items():
        assert taken == sum(f for (q, _), f in chosen.flows.items() if q == p)


def test_too_many_patterns(spark):
    docs = spark.createDataFrame([(i, "w", f"s{i}") for i in range(5)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="patterns"):
        mixing.mix(docs, F.array("source"), max_patterns=4)


def test_copies_keep_columns_of_any_name(spark):
    rows = [(i, "a b c", f"s{i % 2}", f"k{i}", i, -i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id string, _copies int, _copy int")
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    assert out.count() > 0 and set(map(tuple, out.collect())) <= set(rows)


def test_any_number_of_single_sources(spark):
    """More sources than a flow is solved for; targets as of the plain rule, everything near them."""
    n = mixing.MAX_PATTERNS + 2000
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") > 0, F.concat(F.lit("é"), F.hex("id"))).alias("source"),
        F.array_join(F.array_repeat(F.lit("w"), (F.xxhash64("id") % 7 + 7).cast("int")), " ").alias("text"),
    )
    rows = mixing.mix_by_source(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes = {r["source"]: r["source_size"] for r in rows}
    wanted = mixing.targets(sizes, mixing.cyclic_weights(list(sizes)), sum(sizes.values()))
    assert len(rows) == n
    for r in rows:
        assert r["target"] == pytest.approx(wanted[r["source"]])
        assert r["taken"] <= 3 * r["size"] and abs(r["taken"] - r["target"]) <= 0.5
    assert mixing.apply_mix(docs).count() > 0


@pytest.mark.parametrize("sizes", [[0], [0, 0, 3], [10, 10, 10, 1000, 1, 1]])
def test_single_sources_equal_the_flow(spark, sizes):
    rows = [(10 * i + k, f"s{i}" if i else None, " ".join(["w"] * (n // 2 if k else n - n // 2))) for i, n in enumerate(sizes) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    chosen = mixing.mix(docs, F.array("source"))
    plain = {(r["doc_id"], r["size"], r["taken"]) for r in chosen.documents.collect()}
    documents, sources = mixing.mix_of_single_sources(docs)
    found = documents.join(sources, "pattern").collect()
    assert {(r["doc_id"], r["size"], r["taken"]) for r in found} == plain
    assert {(r["doc_id"], r["size"], r["taken"]) for r in mixing.mix_by_source(docs).collect()} == plain
    by_doc = {d: s for d, s, _ in rows}
    assert all((r["source_size"], r["target"]) == pytest.approx(chosen.sources[by_doc[r["doc_id"]]]) for r in found)

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import neighbours, vector_dedup

FIELDS = "vec_id long, embedding array<float>, label int, key string, vector string, component string"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "k", "v", "c") for i, v in rows], FIELDS)


def is_valid(v):
    return v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)


def groups(seed, dim=16, n=60):
    """Groups of near copies, chains of them, exact copies and lone vectors."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n):
        centre = rng.normal(size=dim)
        for k in range(int(rng.integers(1, 8)) if g else 90):
            if g % 5 == 4:
                centre = centre + 0.2 * rng.normal(size=dim)
            rows.append((centre + 0.05 * rng.normal(size=dim) * (k % 3 > 0)).astype(np.float32).tolist())
    return list(enumerate(rows))


ODD = [(9000, None), (9001, [0.0] * 16), (9002, [NAN] + [1.0] * 15), (9003, [INF] + [1.0] * 15), (9004, [None] + [1.0] * 15), (9005, []), (9006, [1.0, 2.0]), (9007, [1.0, 2.0])]


def brute_links(rows):
    valid = [(i, np.array(v, float)) for i, v in rows if is_valid(v)]
    links, root = {}, {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(valid):
        for j, y in valid[:a]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95:
                links[i] = links.get(i, 0) + 1
                links[j] = links.get(j, 0) + 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    return {i: (links.get(i, 0), top(i), top(i) == i) for i, _ in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = groups(seed) + ODD
    found = {r["vec_id"]: tuple(r)[1:] for r in vector_dedup.near_duplicates(table(spark, rows)).collect()}
    assert found == brute_links(rows)


def test_windows_cross_chunks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CHUNK", 50)
    monkeypatch.setattr(vector_dedup, "TILE", 8)
    rows = groups(3, n=25)
    found = {r["vec_id"]: tuple(r)[1:] for r in vector_dedup.near_duplicates(table(spark, rows)).collect()}
    assert found == brute_links(rows)


def test_repeated_rows_and_empty_table(spark):
    v = [1.0] * 16
    rows = [(3, v), (3, v), (None, v), (5, [2.0] * 16), (None, None), (None, [5.0] + [-1.0] * 15)]
    out = sorted(map(tuple, vector_dedup.near_duplicates(table(spark, rows)).collect()), key=str)
    assert out == sorted([(3, 3, 3, True)] * 2 + [(None, 3, 3, False), (5, 3, 3, False), (None, 0, None, False), (None, 0, None, False)], key=str)
    assert vector_dedup.near_duplicates(table(spark, [])).count() == 0


def test_near_duplicates_of_embeddings(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    found = {r["vec_id"]: tuple(r)[1:] for r in vector_dedup.near_duplicates(frame).collect()}
    assert found == brute_links(rows)


def crowded(seed, n, pairs, dim=32):
    """Vectors about one topic that lie close without linking, and pairs of links among them."""
    rng = np.random.default_rng(seed)

    def unit(m):
        return m / np.linalg.norm(m, axis=-1, keepdims=True)

    topic = unit(rng.normal(size=dim))

    def across(m):
        return unit(m - np.outer(m @ topic, topic))

    away = across(rng.normal(size=(n, dim)))
    side = across(away[:pairs] * 0.75 + 0.66 * unit(rng.normal(size=(pairs, dim))))
    near = np.concatenate([away, side]) * 0.42 + topic * 0.9075
    return [(int(i), v.tolist()) for i, v in enumerate(near.astype(np.float32))]


def links_found(spark, rows):
    """How many of the linked vectors were found, after checking that nothing else was."""
    matrix = np.array([v for _, v in rows], float)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    wanted = (matrix @ matrix.T >= 0.95).sum(axis=1) - 1
    found = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicates(table(spark, rows)).collect()}
    assert all(found[i] <= wanted[i] for i in range(len(rows)))
    return sum(found.values()) / wanted.sum()


def test_links_in_a_crowd_are_all_found(spark):
    assert links_found(spark, crowded(1, 6000, 300)) == 1


def test_runs_of_several_passes_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "_run_bits", lambda *_: 5)
    monkeypatch.setattr(vector_dedup, "RUN_TILE", 64)
    assert [vector_dedup.passes_needed(bits, 0.95) for bits in (0, 5, 10, 20)] == [1, 6, 11, 37]
    assert links_found(spark, crowded(2, 3000, 200)) >= 0.98


def brute_neighbours(rows, every=100, k=10):
    valid = [(i, np.array(v, float)) for i, v in rows if is_valid(v)]
    matrix, ids = np.stack([v for _, v in valid]), np.array([i for i, _ in valid])
    out = {}
    for i, v in valid:
        if i % every == 0:
            far = np.sqrt(((matrix - v) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, far)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(far[j])) for j in order]
    return out


def found_neighbours(frame, every=100, **options):
    out = {}
    for r in neighbours.nearest_neighbours(frame, F.expr(f"vec_id % {every} = 0"), **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_of_embeddings(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    wanted = brute_neighbours([(r["vec_id"], r["embedding"]) for r in frame.collect()], every=20)
    found = found_neighbours(frame, every=20)
    assert found.keys() == wanted.keys()
    hits = sum(len({i for i, _ in wanted[q]} & {i for i, _ in found[q]}) for q in wanted)
    assert hits / sum(map(len, wanted.values())) >= 0.9
    for q, rows in found.items():
        assert len(rows) == 10 and rows == sorted(rows, key=lambda r: (r[1], r[0]))


def test_routing_finds_most_with_few_partitions(spark, monkeypatch):
    """Clustered vectors: a few of many partitions hold nearly all neighbours."""
    monkeypatch.setattr(neighbours, "PER_PARTITION", 100)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 12)) * 3
    rows = [(i, (centres[i % 60] + 0.3 * rng.normal(size=12)).astype(np.float32).tolist()) for i in range(3000)]
    points = np.array([v for _, v in rows], float)
    router = neighbours.fit_router(points, 30)
    assert router.parts == 30 and router.probes <= 6
    wanted, found = brute_neighbours(rows), found_neighbours(table(spark, rows))
    hits = sum(len({i for i, _ in wanted[q]} & {i for i, _ in found[q]}) for q in wanted)
    assert hits / sum(map(len, wanted.values())) >= 0.9


def test_partitions_are_balanced():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(500, 8))
    part = neighbours.balanced_partition(points, neighbours.nearest(points, points, 6), 7)
    assert np.bincount(part, minlength=7).max() <= np.ceil(1.1 * 500 / 7) and len(set(part)) == 7


def test_small_tables_are_exact(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).integers(0, 2, 16)]) for i in range(60)] + ODD
    rows += [(0, rows[0][1]), (20, rows[1][1])]
    wanted = {}
    for q in (0, 20, 40):
        mine = [v for i, v in rows if i == q and is_valid(v)]
        if mine:
            wanted[q] = True
    found = found_neighbours(table(spark, rows), every=20)
    assert set(found) == set(wanted)
    lone = [(i, v) for i, v in rows[:60] if is_valid(v)]
    assert found_neighbours(table(spark, lone), every=20) == {
        q: [(i, pytest.approx(s)) for i, s in r] for q, r in brute_neighbours(lone, every=20).items()
    }
    assert found_neighbours(table(spark, lone[:3]), every=1) == {
        q: [(i, pytest.approx(s)) for i, s in r] for q, r in brute_neighbours(lone[:3], every=1).items()
    }
    assert found_neighbours(table(spark, [])) == {}
    assert found_neighbours(table(spark, [(None, [1.0] * 16)])) == {}


def test_lengths_neither_overflow_nor_underflow(spark):
    base = [0.3, -0.2, 0.9]
    rows = [(i, [x * 10.0**power for x in base]) for i, power in enumerate((-300, -200, 0, 0, 200, 300))] + [(9, [-0.3, 0.2, -0.9])]
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == {i: (5, 0, i == 0) for i in range(6)} | {9: (0, 9, True)}


def test_links_at_the_bound_are_counted_as_they_are_found(spark):
    """Pairs whose cosine is the bound itself, up to rounding: links and their number agree."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(30):
        a = rng.normal(size=8)
        a /= np.linalg.norm(a)
        b = rng.normal(size=8)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, (a * 10.0 ** (i - 15)).tolist()), (2 * i + 1, (0.95 * a + np.sqrt(1 - 0.95**2) * b).tolist())]
    found = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by_component = {}
    for r in found:
        by_component.setdefault(r["component_id"], []).append(r["n_links"])
    assert all(n == [0] if len(n) == 1 else min(n) >= 1 for n in by_component.values())

"""Inverted multi-index against brute force."""

import numpy as np

from lorekeel.llm import imi

SCHEMA = "id string, embedding array<float>, unit string, cell int, n int, q string"


def rows(vectors):
    return [(i, v, "x", 1, 2, "y") for i, v in vectors]


def brute(vectors, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x @ x.T, 6 if len(ids) < 1000 else 9)
    out = {}
    for n, i in enumerate(ids):
        order = sorted((-sims[n, m], ids[m]) for m in range(len(ids)) if m != n)
        out[i] = [j for _, j in order[:k]]
    return out


def found(df, **kw):
    out = {}
    for row in sorted(imi.nearest_vectors(df, dims=8, **kw).collect(), key=lambda r: (r["id"], r["rank"])):
        out.setdefault(row["id"], []).append(row["near_id"])
    return out


def some_vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    return {f"v{i:04d}": (centres[i % 12] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist() for i in range(n)}


def test_exact_where_all_cells_are_walked(spark):
    vectors = some_vectors(300)
    df = spark.createDataFrame(rows(vectors.items()), SCHEMA)
    assert found(df, k=4, min_candidates=1000, cell_rows=30) == brute(vectors, 4)


def test_recall_with_few_candidates(spark):
    vectors = some_vectors(600, seed=2)
    want = brute(vectors, 5)
    got = found(spark.createDataFrame(rows(vectors.items()), SCHEMA), k=5, min_candidates=150, cell_rows=20)
    hits = sum(len(set(want[i]) & set(got[i])) for i in want)
    assert hits / (5 * len(want)) >= 0.9


def test_unusable_repeated_and_equal_vectors(spark):
    nan = float("nan")
    data = [("a", [1.0] * 8), ("a", None), ("b", [2.0] * 8), ("c", [3.0] * 8), ("d", [0.0] * 8), ("e", [nan] + [1.0] * 7), ("f", [1.0] * 7), ("g", None), (None, [1.0] * 8), ("h", [1.0] * 7 + [-1.0]), ("h", [1.0] * 7 + [-1.0]), ("i", [1.0, None] + [1.0] * 6)]
    got = found(spark.createDataFrame(rows(data), SCHEMA), k=2)
    # a, b and c point one way; ties go to the smaller id.
    assert got == {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"], "h": ["a", "b"]}


def test_a_hot_vector_costs_one_entry_and_serves_all_ids(spark):
    data = [(f"h{i:04d}", [1.0] * 8) for i in range(400)] + [("z", [1.0] * 7 + [0.5])]
    got = found(spark.createDataFrame(rows(data), SCHEMA), k=3)
    assert got["h0000"] == ["h0001", "h0002", "h0003"]
    assert got["h0399"] == ["h0000", "h0001", "h0002"] and got["z"] == ["h0000", "h0001", "h0002"]
    assert len(got) == 401


def test_hot_cells_are_split_by_residuals(spark, monkeypatch):
    # A third of all vectors lie closer together than any two centroids; each query still reads few of them.
    monkeypatch.setattr(imi, "HOT_SHARES", 2)
    rng = np.random.default_rng(4)
    spot = rng.normal(size=8)
    vectors = {f"d{i:04d}": (spot + 0.01 * rng.normal(size=8)).astype(np.float32).tolist() for i in range(1500)} | some_vectors(3000, seed=5)
    df = spark.createDataFrame(rows(vectors.items()), SCHEMA)
    units = imi.unit_vectors(df, "id", "embedding", 8)
    index = imi.build_index(units, units.count(), 8, 16, 8, 4096, 500)
    assert index.inner and sum(index.rows.values()) == 4500
    assert max(index.rows.values()) < 450
    asked = np.array([vectors[f"d{i:04d}"] for i in range(50)], np.float32)
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    assert all(sum(index.rows[leaf] for leaf in leaves) < 150 + 450 for leaves in index.visited(asked, 150))
    sizes = {}
    for leaf, n in index.rows.items():
        sizes[index.group[leaf]] = sizes.get(index.group[leaf], 0) + n
    assert len(sizes) >= 9 and max(sizes.values()) <= 500
    want, got = brute(vectors, 5), found(df, k=5, min_candidates=300, cell_rows=16, max_centroids=8, sample_rows=4096, group_rows=500)
    assert sum(len(set(want[i]) & set(got[i])) for i in want) / (5 * len(want)) >= 0.9


def test_queries_limit_askers_only(spark):
    vectors = some_vectors(60)
    df = spark.createDataFrame(rows(vectors.items()), SCHEMA)
    got = found(df, k=2, queries=df.filter("id in ('v0001', 'v0002', 'v0001')"))
    want = brute(vectors, 2)
    assert got == {i: want[i] for i in ("v0001", "v0002")}


def test_empty_and_single(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    assert found(spark.createDataFrame(rows([("a", [1.0] * 8)]), SCHEMA)) == {}


def test_pairs_are_distinct_and_ordered(spark):
    df = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "a")], "id string, near_id string")
    assert {tuple(r) for r in imi.neighbour_pairs(df).collect()} == {("a", "b"), ("a", "c")}
    assert imi.neighbour_pairs(df).count() == 2


def test_walk_orders_cells_by_summed_distance():
    first, second = np.array([0.1, 0.5, 0.9]), np.array([0.2, 0.3])
    order = [cell for cell, _ in imi.walk(first, second, {c: 1 for c in range(6)}, 2)]
    sums = [first[c // 2] + second[c % 2] for c in order]
    assert sums == sorted(sums) and sorted(order) == list(range(6))
    assert list(imi.walk(first, second, {5: 3}, 2)) == [(5, 3)]

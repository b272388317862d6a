import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinmatch.operators.components import connected_components
from kinmatch.operators import pivots
from kinmatch.operators.pivots import dealt, forest
from kinmatch.operators.similarity import vector_links, vector_pairs

SCHEMA = "id long, v array<double>, k string"


def clustered(n, centres, spread, d=16, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    x = c[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(rows, threshold):
    return sorted((a, b) for a, u, j in rows for b, v, k in rows if a < b and j == k and len(u) == len(v) and float(np.dot(u, v)) >= threshold)


def groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize(("threshold", "scaled"), [(0.97, False), (0.97, True), (0.2, True), (-0.5, False)])
def test_pairs_and_links_against_brute_force(spark, threshold, scaled):
    """Norms of one, and of very different sizes; a hot key, a small one, copies, zero vectors and other lengths."""
    x = clustered(150, 9, 0.08)
    rng = random.Random(1)
    rows = [(i, (v * (rng.choice([0.3, 1.0, 2.0]) if scaled else 1.0)).tolist(), "hot" if i % 5 else "b") for i, v in enumerate(x)]
    rows += [(1000 + i, rows[3][1], "hot") for i in range(40)] + [(2000 + i, [0.0] * 16, "hot") for i in range(3)] + [(3000, [1.0] * 3, "hot"), (3001, [1.0] * 3, "hot")]
    want = brute(rows, threshold)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, vector_pairs(df, "id", "v", threshold, F.col("k"), block=16).collect()))
    # products at the very threshold may round either way
    assert got == want
    links = vector_links(df, "id", "v", threshold, F.col("k"), block=16)
    assert {r["node"]: r["component_id"] for r in connected_components(links, "a", "b").collect()} == groups(want)


def test_few_vectors_are_compared_where_they_cluster(spark):
    """Of clustered vectors, under a fifth of all pairs meet in a task, and a vector is sent to few of them."""
    n = 4000
    rows = [(i, v.tolist(), "") for i, v in enumerate(clustered(n, 60, 0.05, seed=5))]
    df = spark.createDataFrame(rows, SCHEMA)
    tasks, _ = dealt(df.select("k", "id", "v"), 0.95, 100)
    sizes = tasks.groupBy("k", "cell", "i", "j", "kind").agg(
        F.count_if(F.col("own") == F.col("i")).alias("first"), F.count_if(F.col("own") == F.col("j")).alias("second"),
        F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visits"),
    )
    met = F.when(F.col("kind") == 1, F.col("homes") * F.col("visits")).when(F.col("i") == F.col("j"), F.col("homes") * (F.col("homes") - 1) / 2).otherwise(F.col("first") * F.col("second"))
    assert sizes.agg(F.sum(met)).first()[0] < 0.2 * n * (n - 1) / 2
    assert tasks.count() < 12 * n  # with blocks of 100 alone: 40 n
    assert sizes.agg(F.max(F.col("homes") + F.col("visits"))).first()[0] < 500


def test_a_group_of_near_copies_gives_few_links(spark):
    """1,500 vectors that all match each other: fewer links than two a vector, and few vectors met in tasks."""
    n = 1500
    df = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(clustered(n, 1, 0.01, seed=2))], SCHEMA)
    links = vector_links(df, "id", "v", 0.9, block=400)
    assert links.count() < 2 * n
    tasks, known = dealt(df.select("k", "id", "v"), 0.9, 400, links=True)
    assert known is not None and tasks.count() == 0
    assert {r["component_id"] for r in connected_components(links, "a", "b").collect()} == {0}


def test_forest_connects_the_same():
    rng = random.Random(4)
    for _ in range(50):
        pairs = [tuple(sorted(rng.sample(range(30), 2))) for _ in range(rng.randint(1, 40))]
        a, b = forest(*(np.array(c) for c in zip(*pairs)))
        assert groups(zip(a.tolist(), b.tolist())) == {k: v for k, v in groups(pairs).items()}
        assert len(a) < len(groups(pairs))


def test_a_task_lists_visits_without_vectors():
    """400 vectors without structure, which visit most of 40 cells: each leaves the task once, and slices share the visits."""
    x, n = clustered(400, 400, 0.0, seed=3), 400
    right = pa.table({"pivot": pa.array(range(40), pa.int64()), "p": pa.array(x[:40].tolist()), "radius": pa.array([3.0] * 40), "least": pa.array([-1.0] * 40)})

    def listed(part, parts):
        left = pa.table({"k": pa.array([""] * n), "id": pa.array(range(n), pa.int64()), "v": pa.array(x.tolist()), "most": pa.array([1.0] * n), "slice": pa.array([part] * n), "slices": pa.array([parts] * n)})
        out = pivots._nearest(left, right, 0.2, True, False)
        assert len(out) == n and out.nbytes < n * (16 * 8 + 40 * 16 + 100)
        return {(r["id"], o["cell"]) for r in out.to_pylist() for o in r["visits"]}

    whole, parts = listed(0, 1), [listed(i, 3) for i in range(3)]
    assert len(whole) > 10 * n and sum(map(len, parts)) == len(whole) and set().union(*parts) == whole


@pytest.mark.parametrize("most", [1 << 20, 300])
def test_slices_of_visits_lose_no_pair(spark, monkeypatch, most):
    monkeypatch.setattr(pivots, "VISITS", most)
    rows = [(i, v.tolist(), "") for i, v in enumerate(clustered(300, 300, 0.0, seed=7))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, vector_pairs(df, "id", "v", 0.4, block=16).collect())) == brute(rows, 0.4)
    links = vector_links(df, "id", "v", 0.4, block=16)
    assert {r["node"]: r["component_id"] for r in connected_components(links, "a", "b").collect()} == groups(brute(rows, 0.4))

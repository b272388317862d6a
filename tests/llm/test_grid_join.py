import random

import numpy as np
import pytest

from kinmatch.llm import op01_grid_join as o
from tests.test_operators import brute_components


def brute(rows, threshold):
    """(n_links, component_id) by row of (vec_id, vector)."""
    good = [(i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    x = [np.array(v) / np.linalg.norm(v) for _, v in good]
    links = [(a, b) for a in range(len(good)) for b in range(len(good)) if a != b and len(x[a]) == len(x[b]) and x[a] @ x[b] >= threshold]
    counts = {}
    for a, _ in links:
        counts[good[a][0]] = counts.get(good[a][0], 0) + 1
    return counts, brute_components([(good[a][0], good[b][0]) for a, b in links])


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(i, (centres[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0.05, 0.2, 1.0])).tolist()) for i in range(n)]


@pytest.mark.parametrize(("block", "threshold", "dim"), [(1000, 0.9, 8), (40, 0.9, 8), (25, 0.97, 20), (50, 0.3, 3)])
def test_equals_brute_force(spark, block, threshold, dim, monkeypatch):
    monkeypatch.setattr(o, "LEAF", 16)
    rows = clustered(220, dim, block)
    rows += [(1000 + i, rows[i][1]) for i in range(0, 40, 4)] + [(2000, [3 * x for x in rows[5][1]])]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    counts, parts = brute(rows, threshold)
    got = o.near_duplicates(df, threshold, block).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_links"] == counts.get(r["vec_id"], 0)
        assert r["component_id"] == parts.get(r["vec_id"], r["vec_id"])
        assert r["kept"] == (r["component_id"] == r["vec_id"])


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [1.0, 0.0], None), (4, None, "b"), (5, [], "b"), (6, [0.0, 0.0], "b"), (7, [nan, 1.0], "b"),
        (8, [inf, 1.0], "b"), (9, [None, 1.0], "b"), (10, [1.0, 0.0, 0.0], "b"), (11, [5.0], "b"), (None, [1.0, 0.0], "b"), (12, [1e300, 0.0], "c"),
        (13, [0.0, -0.0], "c"), (14, [0.0, 1.0], "c"), (14, [0.0, 1.0], "c"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id string")
    got = o.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    assert {i: by[i]["n_links"] for i in by} == {1: 3, 2: 3, 3: 3, 12: 3, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 0, 10: 0, 11: 0, None: 0, 13: 0, 14: 1}
    assert {by[i]["component_id"] for i in (1, 2, 3, 12)} == {1} and by[14]["component_id"] == 14 and by[4]["kept"]
    assert by[None]["component_id"] is None and not by[None]["kept"]
    assert o.near_duplicates(df.where("false")).count() == 0
    assert {r["n_links"] for r in o.near_duplicates(df.where("embedding is null")).collect()} == {0}
    with pytest.raises(ValueError):
        o.near_duplicates(df, 0)

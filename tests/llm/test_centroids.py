import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from kinmatch.llm import op13_centroids as o
from kinmatch.llm import queries


def plain_cluster(rows, k=8, rounds=10, size=64, seed=3):
    """In Python's integers, a vector at a time."""
    kept = []
    for i, x in rows:
        if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x):
            kept.append((i, x, [math.floor(Fraction(v) * 1024) for v in x]))
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [v for *_, v in sorted(kept, key=key)[:k]]

    def assign():
        apart = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents] for *_, v in kept]
        return [(d.index(min(d)), min(d)) for d in apart]

    for _ in range(rounds):
        at = assign()
        for c in range(len(cents)):
            own = [v for (*_, v), (b, _) in zip(kept, at) if b == c]
            if own:
                cents[c] = [sum(col) // len(own) for col in zip(*own)]
    at = assign()
    sums = Counter()
    for c, d in at:
        sums[c] += d
    fits = lambda n: n if n < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    total = sum(sums.values())
    return Counter((i, c, fits(d), fits(sums[c]), fits(total), digest[c]) for (i, *_), (c, d) in zip(kept, at))


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(i, x, 7) for i, x in rows], f"vec_id long, embedding array<{kind}>, cluster int")


@pytest.mark.parametrize("scale", [[1.0], [1e-3, 1.0, 3000.0], [1.0, 2e4, 4e5], [1.0, 1e6, 1e17, 1e200], [11000.0, 12000.0]])
def test_against_plain_cluster(spark, monkeypatch, scale):
    """Magnitudes for which doubles, 64-bit integers and Python's integers are needed, mixed."""
    monkeypatch.setattr(o, "ROWS", 8)
    rng = random.Random(13)
    rows = [(i, [rng.gauss(0, rng.choice(scale)) for _ in range(4)]) for i in range(120)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (500, [0.0] * 4), (501, None), (502, [1.0] * 3), (503, [1.0, None, 1.0, 1.0])]
    rows += [(504, [math.nan] + [0.0] * 3), (505, [math.inf] + [0.0] * 3), (506, []), (507, [-0.0, -1e-300, 1e-300, -0.5])]
    got = Counter(map(tuple, o.cluster(table(spark, rows), size=4).collect()))
    assert got == plain_cluster(rows, size=4)


def test_ties_copies_and_empty_clusters(spark):
    same = [(i, [1.0, 2.0]) for i in range(20)]
    assert Counter(map(tuple, o.cluster(table(spark, same), size=2).collect())) == plain_cluster(same, size=2)
    line = [(i, [float(i % 5), 0.0]) for i in range(60)]
    assert Counter(map(tuple, o.cluster(table(spark, line, "float"), size=2, k=3, rounds=4).collect())) == plain_cluster(line, size=2, k=3, rounds=4)
    few = line[:3]
    assert Counter(map(tuple, o.cluster(table(spark, few), size=2).collect())) == plain_cluster(few, size=2)


def test_empty_table(spark):
    empty = o.cluster(table(spark, [(1, None)]))
    assert empty.count() == 0 and empty.columns == o.cluster(table(spark, [(1, [0.5] * 64)])).columns


def test_doubles_are_exact_up_to_the_bound():
    rng = np.random.default_rng(1)
    for most in (2**10, 2**22, 2**23 - 2, 2**23, 2**24, 2**28, 2**40):
        v = rng.integers(-most, most, (50, 64))
        cents = rng.integers(-most, most, (5, 64)).tolist()
        want = [[sum((int(a) - b) ** 2 for a, b in zip(row, c)) for c in cents] for row in v]
        seen = 0
        for rows, cluster, distance, whole in o.nearest(v / 1024.0, cents):
            for r, c, d, w in zip(rows, cluster, distance, whole):
                assert (d, c) == min((x, i) for i, x in enumerate(want[r])) and list(w) == list(v[r])
                seen += 1
        assert seen == 50


def test_query_against_sql_and_plain(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    df = queries.op13_centroid_clusters(spark, sf)
    got = Counter(map(tuple, df.collect()))
    want = con.sql(queries.oracle_sql()["op13_centroid_clusters"])
    assert want.columns == df.columns and got == Counter(want.fetchall())
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got == plain_cluster(rows[:], rounds=10)

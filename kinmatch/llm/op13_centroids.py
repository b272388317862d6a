"""Centroid clustering of whole-number vectors, exact at any magnitude.

Squared distances are |x|^2 - 2 x.c + |c|^2, made for blocks of vectors by BLAS in double precision. A row for which all
of its terms and sums stay below 2^53 is exact that way, in whatever order BLAS adds; other rows are compared in 64-bit
integers where those suffice, and in Python's integers beyond. Sums of clusters are combined by ``treeAggregate`` as
Python's integers; the driver gets one number for each component of a centroid.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Vectors of a block; what a component is multiplied by before its floor is taken.
ROWS, SCALE = 1024, 1024
LONG = 1 << 63


def kept(vectors: DataFrame, size: int) -> DataFrame:
    """``(vec_id, x)``: the vectors of that many components, all of them finite."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: F.abs(v) < F.lit(math.inf))  # NaN is larger than infinity
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == size) & finite)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The rows of a column of lists of one size."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def whole(v: float) -> int:
    """floor(SCALE * v); a large double is a whole number already."""
    return math.floor(v * SCALE) if abs(v) < 2**53 else int(v) * SCALE


def _wholes(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, dtype=object)
    out[...] = [[whole(v) for v in row] for row in x.tolist()]
    return out


def nearest(x: np.ndarray, centroids: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, cluster, distance, whole components) of the rows of each of the three magnitudes; ties go to the smaller number."""
    if not len(x):
        return
    most = max(abs(v) for c in centroids for v in c)
    size = x.shape[1]
    # (|x| + |c|)^2 bounds all terms and sums of them; the roots are rounded down
    reach = np.abs(x).max(axis=1) * SCALE + 1.0 + float(min(most, 1 << 60))
    small = reach < math.isqrt((1 << 53) // size) - 1
    middle = ~small & (reach < math.isqrt((1 << 62) // size) - 1)
    if small.any():
        rows = np.flatnonzero(small)
        v = np.floor(x[rows] * SCALE)
        c = np.array(centroids, dtype=np.float64)
        apart = (v * v).sum(axis=1)[:, None] - 2.0 * (v @ c.T) + (c * c).sum(axis=1)
        cluster = apart.argmin(axis=1)
        yield rows, cluster, apart[np.arange(len(rows)), cluster].astype(np.int64), v.astype(np.int64)
    for chosen, kind in ((middle, np.int64), (~small & ~middle, object)):
        if chosen.any():
            rows = np.flatnonzero(chosen)
            v = np.floor(x[rows] * SCALE).astype(np.int64) if kind is np.int64 else _wholes(x[rows])
            apart = np.stack([((v - np.array(c, dtype=kind)) ** 2).sum(axis=1) for c in centroids], axis=1)
            cluster = np.array([min(range(len(centroids)), key=row.__getitem__) for row in apart.tolist()])
            yield rows, cluster, apart[np.arange(len(rows)), cluster], v


class Sums:
    """For each cluster the sums of components, vectors and distances, as Python's integers."""

    def __init__(self, k: int, size: int):
        self.of = np.zeros((k, size), dtype=object)
        self.count = np.zeros(k, dtype=object)
        self.distance = np.zeros(k, dtype=object)

    def add(self, block: bytes, centroids: list[list[int]]) -> Sums:
        x = np.frombuffer(block, dtype="<f8").reshape(-1, self.of.shape[1])
        for _, cluster, distance, v in nearest(x, centroids):
            for c in np.unique(cluster).tolist():
                own = cluster == c
                # a block's 64-bit sums of components fit; distances may not
                self.of[c] += v[own].sum(axis=0).astype(object)
                self.count[c] += int(own.sum())
                self.distance[c] += sum(distance[own].tolist())
        return self

    def merge(self, other: Sums) -> Sums:
        self.of, self.count, self.distance = self.of + other.of, self.count + other.count, self.distance + other.distance
        return self


def blocks(vectors: DataFrame, size: int) -> RDD:
    """Blocks of vectors as bytes, kept in the shared folder, as each round reads them."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), size).astype("<f8")
            made = [x[at : at + ROWS].tobytes() for at in range(0, len(x), ROWS)]
            if made:
                yield pa.record_batch({"block": pa.array(made, pa.binary())})

    return stored(vectors.select("x").mapInArrow(packed, "block binary")).rdd.map(lambda r: bytes(r[0]))


def summed(parts: RDD, centroids: list[list[int]]) -> Sums:
    """All vectors' sums, with each in its nearest centroid's cluster."""
    k, size = len(centroids), len(centroids[0])
    total = parts.treeAggregate(None, lambda s, b: (s or Sums(k, size)).add(b, centroids), lambda s, t: s.merge(t) if s and t else s or t)
    return total or Sums(k, size)


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of ``seed:vec_id``; a null id counts as empty text, ties go by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [[whole(v) for v in r["x"]] for r in vectors.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, seed: int = 3) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``, one row per vector of ``size`` finite components.

    A component x counts as floor(1024 x). Vectors that are null, of another size or not finite aren't returned. Rows
    that repeat an id each count. With fewer than k vectors there are fewer centroids; an empty table gives an empty
    one. A distance or inertia beyond 2^63 - 1 is null; clusters and centroids are right for such vectors too.
    """
    own = kept(vectors, size)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(own, k, seed)
    if not centroids:
        return own.sparkSession.createDataFrame([], schema)
    parts = blocks(own, size)
    for _ in range(rounds):
        sums = summed(parts, centroids)
        centroids = [[s // n for s in of] if n else c for of, n, c in zip(sums.of.tolist(), sums.count.tolist(), centroids)]
    inertia = summed(parts, centroids).distance.tolist()
    total = sum(inertia)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def fits(n: int) -> int | None:
        return n if n < LONG else None

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for rows, at, distance, _ in nearest(matrix(batch.column("x"), size), centroids):
                at = at.tolist()
                yield pa.record_batch(
                    {
                        "vec_id": ids.take(pa.array(rows)),
                        "cluster": pa.array(at, pa.int32()),
                        "distance": pa.array(map(fits, distance.tolist()), pa.int64()),
                        "cluster_inertia": pa.array([fits(inertia[c]) for c in at], pa.int64()),
                        "inertia": pa.array([fits(total)] * len(at), pa.int64()),
                        "centroid_sha256": pa.array([digests[c] for c in at], pa.string()),
                    }
                )

    return own.mapInArrow(assign, schema)

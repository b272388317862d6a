"""Near-duplicate vectors by an epsilon grid order join (Boehm et al., SIGMOD 2001).

On unit vectors, a cosine of at least t is a distance of at most sqrt(2 - 2t). Vectors are turned to their principal
directions and sorted by the cells, as wide as that distance, which their leading coordinates lie in. The sorted
sequence is cut into blocks. Two blocks are joined only if the boxes around their coordinates are within the distance;
inside a pair, its halves are joined recursively, again skipping those whose boxes are provably distant, down to
small intervals whose products are taken at once and verified in double precision.

A pair of blocks returns how many vectors each one is linked to, and the links of a spanning forest: never a row for
each linked pair. Equal vectors are one entry with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from kinmatch.operators.components import connected_components

#: Vectors that the principal directions are taken from, at most: those of the smallest hashes. They only steer pruning.
DIRECTIONS_FROM = 4096
#: Coordinates that make up the order and the boxes, at most.
LEADING = 16
LEAF = 256
SLACK = 1e-5


def unit(rows: list) -> np.ndarray:
    """Rows of one length scaled to norm 1, in double precision."""
    x = np.array(rows, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(sample: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the principal directions, the widest first."""
    centred = sample - sample.mean(axis=0)
    _, basis = np.linalg.eigh(centred.T @ centred)
    return basis[:, ::-1][:, :LEADING]


def leading(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The coordinates that make up the order and the boxes."""
    return x @ basis if x.shape[1] == len(basis) else x[:, :LEADING]


def as_bytes(v: np.ndarray) -> bytes:
    """A vector's numbers, in single precision if that keeps them."""
    single = v.astype("<f4")
    return single.tobytes() if (single == v).all() else v.astype("<f8").tobytes()


def from_bytes(vecs: list[bytes], dim: int) -> np.ndarray:
    return np.array([np.frombuffer(v, dtype="<f4" if len(v) == 4 * dim else "<f8") for v in vecs], dtype=np.float64).reshape(-1, dim)


def _place(reps: DataFrame, basis: np.ndarray, eps: float) -> DataFrame:
    """``(key, dim, id, w, vec)``: the key orders vectors by their dimension and cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ws, vs = (b.column(c).to_pylist() for c in ("id", "w", "v"))
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vs):
                by_dim.setdefault(len(v), []).append(i)
            for dim, rows in by_dim.items():
                raw = np.array([vs[i] for i in rows])
                cells = np.floor(leading(unit(raw), basis) / eps).astype(np.int64) + (1 << 15)
                keys = np.column_stack([np.full(len(rows), dim), np.clip(cells, 0, 65535)]).astype(">u2")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k.tobytes() for k in keys], pa.binary()),
                        pa.array([dim] * len(rows), pa.int32()),
                        pa.array([ids[i] for i in rows], pa.int64()),
                        pa.array([ws[i] for i in rows], pa.int64()),
                        pa.array([as_bytes(v) for v in raw], pa.binary()),
                    ],
                    names=["key", "dim", "id", "w", "vec"],
                )

    return reps.mapInArrow(run, "key binary, dim int, id long, w long, vec binary")


def _number(placed: DataFrame) -> DataFrame:
    """Adds ``pos``, the place of each vector in the order. Only a count per partition is put in sequence by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            b = b.append_column("part", pa.array([part] * len(b), pa.int32()))
            yield b.append_column("row", pa.array(range(n, n + len(b)), pa.int64()))
            n += len(b)

    schema = "key binary, dim int, id long, w long, vec binary, part int, row long"
    spread = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(spread, "key", "id").sortWithinPartitions("key", "id")
    rows = stored(ordered.mapInArrow(run, schema))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("part", before.alias("skip")), "part").withColumn("pos", F.col("row") + F.col("skip"))


def _packer(basis: np.ndarray):
    def pack(table: pa.Table) -> pa.Table:
        """The rows of a block, in order, as one row for each dimension, with the box of its coordinates."""
        table = table.sort_by("pos")
        dims = table.column("dim").to_numpy()
        out = []
        for dim in np.unique(dims).tolist():
            part = table.filter(pa.array(dims == dim))
            at = leading(unit(from_bytes(part.column("vec").to_pylist(), dim)), basis)
            out.append(
                {
                    "block": part.column("block")[0].as_py(), "dim": dim,
                    **{c: part.column(c).to_pylist() for c in ("id", "w", "vec")}, "lo": at.min(axis=0).tolist(), "hi": at.max(axis=0).tolist(),
                }
            )
        return pa.Table.from_pylist(out, schema=_BLOCK)

    return pack


_BLOCK = pa.schema(
    [("block", pa.int64()), ("dim", pa.int32()), ("id", pa.list_(pa.int64())), ("w", pa.list_(pa.int64())), ("vec", pa.list_(pa.binary()))]
    + [(c, pa.list_(pa.float64())) for c in ("lo", "hi")]
)
_BLOCK_SQL = "block long, dim int, id array<long>, w array<long>, vec array<binary>, lo array<double>, hi array<double>"


def _pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """``(i, j, dim)``: blocks that may hold linked vectors; met by the cells of the first coordinate, then by all."""
    cell = lambda c: F.floor(F.col(c)[0] / eps).cast("int")
    a = blocks.select(F.col("block").alias("i"), "dim", F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"), F.explode(F.sequence(cell("lo"), cell("hi"))).alias("c"))
    b = blocks.select(F.col("block").alias("j"), "dim", "lo", "hi", F.explode(F.sequence(cell("lo") - 1, cell("hi") + 1)).alias("c"))
    gaps = F.zip_with(F.arrays_zip("lo_i", "hi_i"), F.arrays_zip("lo", "hi"), lambda x, y: F.greatest(F.lit(0.0), y["lo"] - x["hi_i"], x["lo_i"] - y["hi"]))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    return a.join(b, ["dim", "c"]).where("i <= j").where(apart <= eps * eps + 1e-9).select("i", "j", "dim").distinct()


def _boxes(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, len(at), LEAF)
    return np.minimum.reduceat(at, starts), np.maximum.reduceat(at, starts)


def join_blocks(a: dict, b: dict | None, threshold: float, eps: float) -> tuple[list, list]:
    """Links in a block, or between two: [(id, linked)] and the spanning links [(id, id)]."""
    own = b is None
    b = b or a
    na, counts_a, counts_b = len(a["ids"]), np.zeros(len(a["ids"]), np.int64), np.zeros(len(b["ids"]), np.int64)
    (alo, ahi), (blo, bhi) = _boxes(a["at"]), _boxes(b["at"])
    xa, xb = a["vec"].astype(np.float32), b["vec"].astype(np.float32)
    label = np.arange(na if own else na + len(b["ids"]))
    shift = 0 if own else na
    links: list[tuple[int, int]] = []
    limit = eps * eps + 1e-9

    def leaf(i: int, j: int) -> None:
        r, c = i * LEAF, j * LEAF
        near = np.argwhere(xa[r : r + LEAF] @ xb[c : c + LEAF].T >= threshold - SLACK)
        if own and i == j:
            near = near[near[:, 0] < near[:, 1]]
        if not len(near):
            return
        p, q = near[:, 0] + r, near[:, 1] + c
        sure = np.einsum("ij,ij->i", a["vec"][p], b["vec"][q]) >= threshold
        p, q = p[sure], q[sure]
        if not len(p):
            return
        np.add.at(counts_a, p, b["ws"][q])
        np.add.at(counts_a if own else counts_b, q, a["ws"][p])
        for x, first, n in zip(*np.unique(p, return_index=True, return_counts=True)):
            to = q[first : first + n]
            labels = label[to + shift]
            new, where = np.unique(labels, return_index=True)
            fresh = new != label[x]
            if fresh.any():
                links.extend((int(a["ids"][x]), int(b["ids"][y])) for y in to[where[fresh]])
                label[np.isin(label, new)] = label[x]

    def join(i0: int, i1: int, j0: int, j1: int) -> None:
        if own and j1 <= i0:
            return
        gap = np.maximum(0, np.maximum(blo[j0:j1].min(axis=0) - ahi[i0:i1].max(axis=0), alo[i0:i1].min(axis=0) - bhi[j0:j1].max(axis=0)))
        if gap @ gap > limit:
            return
        if i1 - i0 == 1 and j1 - j0 == 1:
            if not own or i0 <= j0:
                leaf(i0, j0)
        elif i1 - i0 >= j1 - j0:
            mid = (i0 + i1) // 2
            join(i0, mid, j0, j1)
            join(mid, i1, j0, j1)
        else:
            mid = (j0 + j1) // 2
            join(i0, i1, j0, mid)
            join(i0, i1, mid, j1)

    join(0, len(alo), 0, len(blo))
    counts = [(int(a["ids"][k]), int(counts_a[k])) for k in np.flatnonzero(counts_a)]
    if not own:
        counts += [(int(b["ids"][k]), int(counts_b[k])) for k in np.flatnonzero(counts_b)]
    return counts, links


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, block: int | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors (vec_id, embedding)``.

    Linked are vectors of one length whose cosine, in double precision, is at least ``threshold``. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, nor do rows with a null vec_id (their
    component is null). Repeated rows are vectors of their own. An empty table gives an empty one.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    eps = math.sqrt(2 - 2 * threshold) + 1e-6
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fit = F.col("vec_id").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(fit, F.lit(False)), F.col("v")))
    reps = stored(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("w")))
    n = reps.count()
    sample = [r["v"] for r in reps.orderBy(F.xxhash64("id"), "id").limit(DIRECTIONS_FROM).collect()]
    dim = max(set(map(len, sample)), key=list(map(len, sample)).count, default=1)
    basis = directions(unit([v for v in sample if len(v) == dim])) if sample else np.eye(1)
    block = block or max(1024, min(8192, n // 12))
    numbered = _number(_place(reps, basis, eps)).withColumn("block", F.floor(F.col("pos") / block).cast("long"))
    blocks = stored(numbered.select("block", "pos", "dim", "id", "w", "vec").groupBy("block").applyInArrow(_packer(basis), _BLOCK_SQL))
    pairs = _pairs(blocks.select("block", "dim", "lo", "hi"), eps)
    sides = pairs.select("i", "j", "dim", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    dealt = sides.join(blocks.select("block", "dim", "id", "w", "vec"), ["block", "dim"])

    def compare(table: pa.Table) -> pa.Table:
        made = []
        for r in sorted(table.to_pylist(), key=lambda r: r["block"]):
            x = unit(from_bytes(r["vec"], r["dim"]))
            made.append({"ids": np.array(r["id"]), "ws": np.array(r["w"]), "vec": x, "at": leading(x, basis)})
        counts, links = join_blocks(made[0], made[1] if len(made) > 1 else None, threshold, eps)
        a = [x for x, _ in counts] + [x for x, _ in links]
        b = [None] * len(counts) + [y for _, y in links]
        n = [k for _, k in counts] + [None] * len(links)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    found = stored(dealt.groupBy("i", "j", "dim").applyInArrow(compare, "a long, b long, n long"))
    linked = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "id")
    parts = connected_components(found.where("b is not null"), "a", "b").withColumnRenamed("node", "id")
    of_rep = reps.join(linked, "id", "left").join(parts, "id", "left").select(
        "v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    return rows.join(of_rep, "v", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )

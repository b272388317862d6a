"""Self-join of vectors by their inner product, pruned by pivots and the triangle inequality of angles.

Two vectors with a product of at least t > 0, and norms of at most N, are at an angle of at most arccos(t / (|x| N)) = r(x).
Some vectors of a key are its pivots; each vector lives in the cell of the nearest. If x lives at p and y at q, and they
match, then angle(x, q) <= r + angle(y, q) <= r + angle(y, p) <= 2 r + angle(x, p): so a vector has to visit only the cells
whose pivots are nearly as near as its own, and only those after its own, as the pair is met from the other side
otherwise; and of these only the ones whose radius, the largest angle of a vector at home there, comes within r of it. A
cell is compared in tasks of bounded size, within which vectors whose angles to the pivot are further apart
than r are skipped. A key that fits in one block has no pivots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import stored

#: What is added to angles, so that rounding loses no pair.
SLACK = 1e-6
#: Rows of a task's matrix that are compared at a time; pivots expected at least.
STEP, LEAST_PIVOTS = 512, 12
#: Visits that a task lists at most, by its rows times its cells.
VISITS = 1 << 20


def matrix(table: pa.Table, column: str = "v") -> np.ndarray:
    """The vectors of a table, in double precision; a null component is not a number."""
    flat = table.column(column).combine_chunks().flatten().cast(pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(table), -1)


def reach(threshold: float, norms: np.ndarray, most: float) -> np.ndarray:
    """The largest angle at which vectors of these norms match one of a norm up to ``most``; below 0 where none can."""
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = threshold / (norms * most)
    return np.where(cosine > 1 + 1e-9, -1.0, np.arccos(np.clip(cosine - 1e-9, -1.0, 1.0)) + SLACK)


def _number(of: str, salt: int):
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.col(of)).cast("int")


def _nearest(left: pa.Table, right: pa.Table, threshold: float, visits: bool, links: bool) -> pa.Table:
    """The rows with their own cell, the angle to its pivot and the product with it; with ``visits``, also the cells that they visit.

    A row's visits are an array, so that its vector is there once. They take account of the cells' ``radius`` and, with
    ``links``, of the ``least`` product of a row at home with its pivot. Of ``slices`` of the cells a task lists its ``slice``.
    """
    x, names = matrix(left), right.column("pivot").to_numpy()
    most = left.column("most")[0].as_py() or 0.0
    norms = np.sqrt((x * x).sum(axis=1))
    reaches = reach(threshold, norms, most)
    p = matrix(right, "p") if len(right) else np.zeros((0, x.shape[1]))
    lengths = np.sqrt((p * p).sum(axis=1))
    use = np.flatnonzero(lengths > 0)
    use = use[np.argsort(names[use], kind="stable")]
    given, names = p[use], names[use]
    p = given / lengths[use][:, None]
    radius, least = ((right.column(c).to_numpy(zero_copy_only=False).astype(float)[use] if visits else None) for c in ("radius", "least"))
    # an empty cell is NaN, which no comparison holds for
    joined = (given @ given.T >= threshold) & (least >= threshold) if links and visits else None
    listed = np.arange(len(names)) % left.column("slices")[0].as_py() == left.column("slice")[0].as_py() if visits else None
    at, cell, angles, products, counts, visited, far = ([] for _ in range(7))
    for lo in range(0, len(x), STEP):
        part = np.arange(lo, min(lo + STEP, len(x)))
        part = part[(reaches[part] >= 0) & (norms[part] > 0)]  # others match nothing
        at.append(part)
        if not len(names):  # no pivot was drawn: one cell
            cell.append(np.zeros(len(part), np.int64))
            angles.append(np.zeros(len(part)))
            products.append(np.full(len(part), -np.inf))
            counts.append(np.zeros(len(part), np.int64))
            continue
        away = np.arccos(np.clip(x[part] @ p.T / norms[part][:, None], -1.0, 1.0))
        own = away.argmin(axis=1)
        cell.append(names[own])
        angles.append(away[np.arange(len(part)), own])
        products.append((x[part] * given[own]).sum(axis=1))
        if visits:
            near = away <= (angles[-1] + 2 * reaches[part])[:, None]
            near &= away - reaches[part][:, None] <= radius  # not for a cell without rows, whose radius is NaN
            near &= (np.arange(len(names)) > own[:, None]) & listed
            if joined is not None:  # linked by way of the two pivots
                near &= ~((products[-1] >= threshold)[:, None] & joined[own])
            i, j = np.nonzero(near)
            counts.append(near.sum(axis=1))
            visited.append(names[j])
            far.append(away[i, j])
    taken = left.take(pa.array(np.concatenate(at)))
    out = {"k": taken.column("k"), "cell": pa.array(np.concatenate(cell), pa.int64()), "angle": pa.array(np.concatenate(angles)), "product": pa.array(np.concatenate(products)), "id": taken.column("id")}
    if visits:
        ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]), pa.int32())
        each = pa.StructArray.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in ((visited, pa.int64()), (far, pa.float64()))], names=["cell", "angle"])
        out |= {"first": pa.array(np.full(len(taken), left.column("slice")[0].as_py() == 0)), "most": taken.column("most"), "v": taken.column("v"), "visits": pa.ListArray.from_arrays(ends, each)}
    return pa.table(out)


def _in_cells(rows: DataFrame, sizes: DataFrame, threshold: float, block: int, links: bool) -> tuple[DataFrame, DataFrame | None]:
    """``(k, cell, home, tight, angle, most, id, v)`` of the rows of large keys: one row at home, and one for each cell that is visited.

    With ``links``, also the links ``(a, b)`` of pivots with each other and with the rows at home. A cell all of whose rows
    match the pivot is ``tight``: they are linked already; and rows that match their own pivot needn't visit a tight cell
    whose pivot matches theirs. So a dense group costs as many comparisons as it has rows and pivots, not pairs.

    Rows are dealt by hash into chunks, each of which gets all pivots of its key: about twice as many as there are blocks,
    up to four times the root of the rows, and at most half as many in a chunk as it has rows. A first pass finds the
    radius of each cell, a second one lists the cells that each row visits, as many in a task as ``VISITS`` allows, and
    Spark sends the rows there.
    """
    pivots = F.least(2 * F.ceil(F.col("n") / block), 4 * F.ceil(F.sqrt("n"))) + LEAST_PIVOTS
    plan = sizes.select("k", "n", "most", pivots.alias("pivots"))
    held = F.greatest(F.lit(block), 2 * F.col("pivots"))
    plan = plan.withColumn("chunks", F.ceil(F.col("n") / held).cast("int")).withColumn("slices", F.ceil(held * F.col("pivots") / VISITS).cast("int"))
    placed = rows.join(plan, "k")
    chosen = stored(placed.where(F.pmod(F.xxhash64("id", F.lit(1)), F.col("n")) < F.col("pivots")).select("k", "chunks", "slices", F.col("id").alias("pivot"), F.col("v").alias("p")))
    dealt = placed.select("k", _number("chunks", 2).alias("chunk"), "slices", "id", "v", "most")
    kind = rows.schema["v"].dataType
    of_row = [("k", "string", pa.string()), ("cell", "long", pa.int64()), ("angle", "double", pa.float64()), ("product", "double", pa.float64()), ("id", "long", pa.int64())]
    visit = pa.list_(pa.struct([("cell", pa.int64()), ("angle", pa.float64())]))
    of_visits = [("first", "boolean", pa.bool_()), ("most", "double", pa.float64()), ("v", kind.simpleString(), to_arrow_type(kind)), ("visits", "array<struct<cell: long, angle: double>>", visit)]

    def cells(pivots: DataFrame, visits: bool) -> DataFrame:
        columns = [*of_row, *of_visits] if visits else of_row
        none = pa.schema([(name, arrow) for name, _, arrow in columns])

        def assign(left: pa.Table, right: pa.Table) -> pa.Table:
            return _nearest(left, right, threshold, visits, links) if len(left) else none.empty_table()

        slice_ = (F.explode(F.sequence(F.lit(0), F.col("slices") - 1)) if visits else F.lit(0)).alias("slice")
        to_all = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("*", slice_)
        return dealt.select("*", slice_).groupBy("k", "chunk", "slice").cogroup(to_all.groupBy("k", "chunk", "slice")).applyInArrow(assign, ", ".join(f"{name} {sql}" for name, sql, _ in columns))

    homes = cells(chosen, False)
    homes = stored(homes) if links else homes
    radii = homes.groupBy("k", "cell").agg(F.max("angle").alias("radius"), F.min("product").alias("least"))
    known = stored(chosen.join(radii.withColumnRenamed("cell", "pivot"), ["k", "pivot"], "left"))
    tight = known.select("k", F.col("pivot").alias("cell"), (F.lit(links) & (F.col("least") >= threshold)).alias("tight"))
    own = F.when(F.col("first"), F.array(F.struct("cell", F.lit(True).alias("home"), "angle"))).otherwise(F.array().cast("array<struct<cell: long, home: boolean, angle: double>>"))
    others = F.transform("visits", lambda o: F.struct(o["cell"].alias("cell"), F.lit(False).alias("home"), o["angle"].alias("angle")))
    found = cells(known, True).select("k", "most", "id", "v", F.explode(F.concat(own, others)).alias("_c")).select("k", "_c.*", "most", "id", "v")
    found = found.join(tight, ["k", "cell"], "left").withColumn("tight", F.coalesce("tight", F.lit(False)))
    found = found.select("k", "cell", "home", "tight", "angle", "most", "id", "v")
    if not links:
        return found, None

    def among(table: pa.Table) -> pa.Table:
        names, p = table.column("pivot").to_numpy(), matrix(table, "p")
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo in range(0, len(p), STEP):
            i, j = np.nonzero(p[lo : lo + STEP] @ p.T >= threshold)
            one = forest(np.concatenate([a[-1], names[i + lo]]), np.concatenate([b[-1], names[j]]))
            a, b = [one[0]], [one[1]]
        return pa.table({"a": pa.array(a[-1], pa.int64()), "b": pa.array(b[-1], pa.int64())})

    pivoted = known.select("k", "pivot", "p").groupBy("k").applyInArrow(among, "a long, b long")
    own = homes.where((F.col("product") >= threshold) & (F.col("cell") != F.col("id"))).select(F.least("cell", "id").alias("a"), F.greatest("cell", "id").alias("b"))
    return found, pivoted.unionByName(own)


def dealt(rows: DataFrame, threshold: float, block: int, links: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """``(k, cell, i, j, kind, own, id, v, home, angle, most)`` of ``rows (k, id, v)``: the tasks (k, cell, i, j, kind) and what each compares.

    With ``links``, also links that are known without comparison, if any; the tasks needn't find what these connect. Kind 0: the blocks i <= j of the vectors at home; kind 1: block i of those at home with block j of the visitors.
    """
    large = rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > block)
    alone = [F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"), F.lit(False).alias("tight"), F.lit(0.0).alias("angle"), F.lit(0.0).alias("most"), "id", "v"]
    cells, known = rows.select("k", *alone), None
    if large.isEmpty():  # one block a key
        zero = [F.lit(0).alias(c) for c in ("i", "j", "kind", "own")]
        return cells.select("k", "cell", *zero, "id", "v", "home", "angle", "most"), None
    if threshold > 0:  # else no angle bounds a product
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        large = stored(rows.groupBy("k").agg(F.count("*").alias("n"), F.max(F.when(~F.isnan(norm), norm)).alias("most")).where(F.col("n") > block))
        in_cells, known = _in_cells(rows, large, threshold, block, links)
        cells = stored(cells.join(large.select("k"), "k", "left_anti").unionByName(in_cells))
    counts = cells.groupBy("k", "cell").agg(F.ceil(F.count_if("home") / block).cast("int").alias("homes"), F.ceil(F.count_if(~F.col("home")) / block).cast("int").alias("visits"))
    placed = cells.join(counts, ["k", "cell"]).where("homes > 0")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.when(F.col("home"), F.col("homes")).otherwise(F.col("visits"))).cast("int"))

    def upto(n: str):
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    def place(i, j, kind: int):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"))

    own = F.col("own")
    among = F.transform(F.when(F.col("tight"), F.array().cast("array<int>")).otherwise(upto("homes")), lambda o: place(F.least(own, o), F.greatest(own, o), 0))
    at_home = F.concat(among, F.transform(upto("visits"), lambda o: place(own, o, 1)))
    visiting = F.transform(upto("homes"), lambda o: place(o, own, 1))
    tasks = placed.withColumn("t", F.explode(F.when(F.col("home"), at_home).otherwise(visiting)))
    return tasks.select("k", "cell", "t.i", "t.j", "t.kind", "own", "id", "v", "home", "angle", "most"), known


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (a, b) connect: each element, but the least of its group, to the least."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    group = np.arange(len(names))
    while True:
        least = np.minimum(group[x], group[y])
        new = group.copy()
        np.minimum.at(new, group[x], least)
        np.minimum.at(new, group[y], least)
        while (new != new[new]).any():
            new = new[new]
        new = new[group]
        if (new == group).all():
            break
        group = new
    moved = np.flatnonzero(group != np.arange(len(group)))
    return names[group[moved]], names[moved]


#: Pairs that a task holds before it turns them into a forest.
HELD = 1 << 20


def compared(tasks: DataFrame, threshold: float, links: bool) -> DataFrame:
    """``(a, b)``, a < b: the matching pairs of each task; with ``links``, only as many as connect what they connect."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, own, i, home, angle = (table.column(c).to_numpy() for c in ("id", "own", "i", "home", "angle"))
        x = matrix(table)
        kind, first, second = (table.column(c)[0].as_py() for c in ("kind", "i", "j"))
        left = np.flatnonzero(home if kind else own == first)
        right = np.flatnonzero(~home) if kind else left if first == second else np.flatnonzero(own == second)
        left, right = left[np.argsort(angle[left], kind="stable")], right[np.argsort(angle[right], kind="stable")]
        most = table.column("most")[0].as_py()
        within = float(reach(threshold, np.array([most]), most)[0]) if threshold > 0 and most else np.inf
        a, b, held = [], [], 0
        for lo in range(0, len(left), STEP):
            part = left[lo : lo + STEP]
            near = right[np.searchsorted(angle[right], angle[part[0]] - within) : np.searchsorted(angle[right], angle[part[-1]] + within, "right")]
            p, q = np.nonzero(x[part] @ x[near].T >= threshold)
            p, q = ids[part[p]], ids[near[q]]
            keep = p < q if left is right or not kind and first == second else p != q
            a.append(np.minimum(p, q)[keep])
            b.append(np.maximum(p, q)[keep])
            held += len(a[-1])
            if links and held > HELD:
                fewer = forest(np.concatenate(a), np.concatenate(b))
                a, b = [fewer[0]], [fewer[1]]
                held = len(a[0])
        a, b = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (a, b))
        if links and len(a):
            a, b = forest(a, b)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tasks.groupBy("k", "cell", "i", "j", "kind").applyInArrow(compare, "a long, b long")

"""Pairs of similar rows: by shared tokens, or by vectors in blocks.

Both are blocked by an equi key where there is one. Texts are compared once per distinct text, so copies cost nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..sources.shared import stored
from .pivots import HELD, compared, dealt, forest, matrix

#: Vectors in a block, on average; a task compares two blocks of one key.
BLOCK = 2048


def distinct_texts(rows: DataFrame, text: str, key: str | None = None) -> DataFrame:
    """``(t, k, rep, n)``: each text (within its key) with its smallest row number and its count."""
    k = F.col(key) if key else F.lit("")
    return rows.groupBy(F.col(text).alias("t"), k.alias("k")).agg(F.min("row_no").alias("rep"), F.count("*").alias("n"))


def text_id(text: str, key: str) -> Column:
    """A digest that stands for a text within its key, wherever its rows are and however they are numbered."""
    return F.sha2(F.concat_ws("\x1f", F.length(key).cast("string"), key, text), 256)


def token_weights(texts: DataFrame) -> DataFrame:
    """``(rep, k, token, w)``: unit vectors of the token frequencies of ``texts (t, k, rep)``, in lower case."""
    tokens = texts.select("rep", "k", F.explode(F.split(F.lower("t"), r"\s+")).alias("token")).where("token <> ''")
    tf = tokens.groupBy("rep", "k", "token").agg(F.count("*").alias("tf"))
    norms = tf.groupBy("rep").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    return tf.join(norms, "rep").select("rep", "k", "token", (F.col("tf") / F.col("norm")).alias("w"))


def _prefix(side: DataFrame, common: DataFrame, threshold: float) -> DataFrame:
    """``(k, token, rep)``: of a row's tokens, as many as a similar row must share one of, the rarest ones.

    The others' squared weights are below the squared threshold, so they can't make a pair alone. Rows that rank tokens
    alike, by ``common (k, token, df)``, have the rarest token that they share among those of either.
    """
    rest = Window.partitionBy("rep").orderBy(F.col("df").desc(), "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = side.join(common, ["k", "token"]).withColumn("run", F.sum(F.col("w") * F.col("w")).over(rest))
    return ranked.where(F.col("run") >= threshold * threshold - 1e-9).select("k", "token", "rep")


def token_pairs(a: DataFrame, b: DataFrame, threshold: float, own: bool) -> DataFrame:
    """``(a, b, cosine)`` of rows of two token tables with one key whose cosine is at least the threshold.

    ``own``: a and b are one table, of which each pair is taken once. Only rows with a shared token can be similar, so
    the join is on key and token, of the tokens of ``_prefix`` only. For groups of similar rows ``token_links`` needs no
    row for each pair.
    """
    common = b.groupBy("k", "token").agg(F.count("*").alias("df"))
    meet = _prefix(a, common, threshold).withColumnRenamed("rep", "a").join(_prefix(b, common, threshold).withColumnRenamed("rep", "b"), ["k", "token"])
    candidates = meet.where("a <> b" if own else "true").select("k", *([F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")] if own else ["a", "b"])).distinct()
    x = a.select("k", F.col("rep").alias("a"), "token", F.col("w").alias("wa"))
    y = b.select("k", F.col("rep").alias("b"), "token", F.col("w").alias("wb"))
    scored = candidates.join(x, ["k", "a"]).join(y, ["k", "b", "token"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return scored.where(F.col("cosine") >= threshold - 1e-12)


#: Rows of a bucket of one key and token that a task takes, or twice as many of two parts of one; rows of small buckets of a task.
BUCKET, SMALL = 2048, 1 << 14


def _bucket_links(ids: np.ndarray, first: np.ndarray, rows: list[list[dict]], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between similar rows of a bucket, by postings; between those in ``first`` and the others, unless all are."""
    whole = bool(first.all())
    postings: dict[str, tuple[list[int], list[float]]] = {}
    for n in range(len(rows)) if whole else np.flatnonzero(first).tolist():
        for t in rows[n]:
            at, w = postings.setdefault(t["token"], ([], []))
            at.append(n)
            w.append(t["w"])
    arrays = {t: (np.array(at), np.array(w)) for t, (at, w) in postings.items()}
    a, b, held = [], [], 0
    for n in range(len(rows)) if whole else np.flatnonzero(~first).tolist():
        score = np.zeros(len(rows))
        for t in rows[n]:
            if t["token"] in arrays:
                at, w = arrays[t["token"]]
                score[at] += w * t["w"]
        near = np.flatnonzero(score >= threshold - 1e-12)
        near = near[near < n] if whole else near
        a.append(np.minimum(ids[near], ids[n]))
        b.append(np.maximum(ids[near], ids[n]))
        held += len(near)
        if held > HELD:
            one = forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [one[0]], [one[1]], len(one[0])
    if not held:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(np.concatenate(a), np.concatenate(b))


def token_links(weights: DataFrame, threshold: float, bucket: int = BUCKET, small: int = SMALL) -> DataFrame:
    """``(a, b)``, a < b: links that connect the rows of ``weights (rep, k, token, w)`` whose cosine is at least the threshold.

    Rows meet in the buckets of the tokens of ``_prefix``, with all their tokens, and no row is made for a pair: a task
    returns a forest of what it has found, at most one link for each of its rows. Many small buckets share a task; a
    bucket with too many rows (a hot token) is cut into parts, of which each pair is a task. A link needn't be a pair itself.
    """
    common = weights.groupBy("k", "token").agg(F.count("*").alias("df"))
    prefix = stored(_prefix(weights, common.where("df > 1"), threshold))  # a token that no other row has links nothing
    sizes = prefix.groupBy("k", "token").agg(F.count("*").alias("n")).where("n > 1")
    whole = weights.groupBy("rep").agg(F.collect_list(F.struct("token", "w")).alias("row"))
    tasks = max(1, -(-prefix.count() // small))
    parts = F.ceil(F.col("n") / bucket).cast("int")
    dealt = prefix.join(sizes, ["k", "token"]).withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    dealt = dealt.withColumn("p", F.explode(others))
    task = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("k", "token"), F.lit(tasks))).otherwise(F.xxhash64("k", "token", "p.i", "p.j"))
    name = F.xxhash64("k", "token", "p.i", "p.j").alias("name")
    given = dealt.select(task.alias("task"), name, "k", "token", "p.i", "own", "rep").join(whole, "rep")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("name", "k", "token")]).combine_chunks()
        names = list(zip(*(table.column(c).to_pylist() for c in ("name", "k", "token"))))
        ids, first, rows = table.column("rep").to_numpy(), table.column("own").to_numpy() == table.column("i").to_numpy(), table.column("row")
        a, b, lo = [], [], 0
        for hi in range(1, len(names) + 1):
            if hi == len(names) or names[hi] != names[lo]:
                x, y = _bucket_links(ids[lo:hi], first[lo:hi], rows.slice(lo, hi - lo).to_pylist(), threshold)
                a, b, lo = [*a, x], [*b, y], hi
        return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    return given.groupBy("task").applyInArrow(compare, "a long, b long").distinct()


def _keyed(rows: DataFrame, id_: str, vector: str, key: Column | None) -> DataFrame:
    """``(k, id, v)``: vectors of one length under one key; a null or empty vector is left out."""
    keyed = rows.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v"), (F.lit("") if key is None else F.coalesce(key.cast("string"), F.lit(""))).alias("k"))
    return keyed.where(F.size("v") > 0).withColumn("k", F.concat_ws(":", F.size("v").cast("string"), "k"))


def vector_pairs(rows: DataFrame, id_: str, vector: str, threshold: float, key: Column | None = None, block: int = BLOCK) -> DataFrame:
    """``(a, b)``, a < b: rows of one key whose vectors' inner product, in double precision, is at least the threshold.

    Pairs of vectors that can't match are skipped by pivots, where a key has more rows than a block; each task is of
    bounded size. A null or empty vector, or one with null components, has no pair; vectors of other lengths aren't
    compared; a threshold of 0 or less skips nothing.
    """
    tasks, _ = dealt(_keyed(rows, id_, vector, key), threshold, block)
    return compared(tasks, threshold, links=False)


def vector_links(rows: DataFrame, id_: str, vector: str, threshold: float, key: Column | None = None, block: int = BLOCK) -> DataFrame:
    """``(a, b)``, a < b: links that connect what the pairs of ``vector_pairs`` connect, for grouping.

    Equal vectors of a key are compared once. A task returns a forest of what it has found, at most one link for each of
    its rows, so that a group of n near copies gives in the order of n links. A link needn't be a pair itself.
    """
    keyed = _keyed(rows, id_, vector, key)
    distinct = stored(keyed.groupBy("k", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    tasks, known = dealt(distinct.select("k", "id", "v"), threshold, block, links=True)
    links = compared(tasks, threshold, links=True)
    links = links if known is None else links.unionByName(known)
    copied = distinct.where((F.col("copies") > 1) & (dot(F.col("v"), F.col("v")) >= threshold)).select("k", "v", F.col("id").alias("a"))
    return links.unionByName(keyed.join(copied, ["k", "v"]).where("a <> id").select("a", F.col("id").alias("b")))


def vector_probe(candidates: DataFrame, rows: DataFrame, threshold: float, key: bool, block: int = BLOCK) -> DataFrame:
    """``(cand, id)``: rows ``(id, v, k)`` whose product with a candidate ``(cand, v, k)`` is at least the threshold.

    With ``key``, an equi-join on k, of any size. Without, both are dealt into blocks by hash, and each pair of a block of
    candidates and one of rows is a task of bounded size. Null vectors, and such of other lengths, match nothing.
    """
    if key:
        on = (F.col("c.k") == F.col("r.k")) & (dot(F.col("c.v"), F.col("r.v")) >= threshold)
        return candidates.alias("c").join(rows.alias("r"), on).select("cand", "id")
    sides = [candidates.select(F.col("cand").alias("_id"), "v"), rows.select(F.col("id").alias("_id"), "v")]
    counts = [max(1, -(-side.count() // block)) for side in sides]

    def dealt(n: int) -> DataFrame:
        own = F.pmod(F.xxhash64("_id"), F.lit(counts[n])).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.lit(counts[1 - n] - 1)))
        side = sides[n].where(F.size("v") > 0).select("_id", "v", F.size("v").alias("d"), own.alias("own"), each.alias("other"))
        place = ("own", "other") if n == 0 else ("other", "own")
        return side.select(F.col(place[0]).alias("i"), F.col(place[1]).alias("j"), "d", "v", F.lit(n).alias("side"), *[F.col("_id").alias(x) if k == n else F.lit(None).cast(sides[k].schema["_id"].dataType).alias(x) for k, x in enumerate(("cand", "id"))])

    both = dealt(0).unionByName(dealt(1))

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        x = matrix(table)
        p, q = np.nonzero(x[left] @ x[right].T >= threshold)
        return pa.table({"cand": table.column("cand").take(pa.array(left[p])), "id": table.column("id").take(pa.array(right[q]))})

    return both.groupBy("i", "j", "d").applyInArrow(compare, both.select("cand", "id").schema)


def exact_vector_groups(rows: DataFrame, id_: str, vector: str, digits: int = 6) -> DataFrame:
    """``(group_min, size)`` of at least two rows with equal vectors after rounding."""
    rounded = F.transform(F.col(vector), lambda x: F.bround(x.cast("double"), digits) + F.lit(0.0))
    return rows.groupBy(rounded.alias("v")).agg(F.min(id_).alias("group_min"), F.count("*").alias("size")).where("size > 1").select("group_min", "size")

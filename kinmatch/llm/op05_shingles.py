"""SimHash near copies whose sets of shingles are similar.

A text's fingerprint is the SimHash, in two words of 64 bits, of its set of distinct shingles. Pairs within ``radius``
bits are found by multi-index hashing (op05_simhash.links); a pair is linked if it is one of these and the Jaccard
similarity of the complete sets is ``similarity`` or more. At a similarity of 0.8 a bit differs with a probability of 0.15
(19 of 128 on average, with a deviation of 4); the default radius of 26 loses about 1 of 25 pairs that are just that
similar, and next to none from 0.85 on.

The fingerprints that are connected make a bundle, and sets are only compared within a bundle: in one task where it is
small. A large one is dealt into blocks, and each block is compared in itself and with some pivots of the bundle. Of what
isn't connected to most of the bundle then, blocks are compared with all blocks. A task returns links that connect what
it has found, one for a set at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .op05_simhash import SHARE, links, majority, merged, remixed, shingle_hashes, signed
from kinmatch.operators.components import connected_components

#: Shingles of a block of a bundle, about, and members at most on average; pivots of a bundle.
BLOCK_SHINGLES, BLOCK, PIVOTS = 1 << 21, 1024, 8
SLACK = 1e-9
WORDS = ("fp", "more")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def _rows(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, text_key, set_key, size, fp, more)`` of each row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(t, words) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "text_key": part.column("text_key"),
                    "set_key": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    "size": pa.array([len(s) for s in sets], pa.int32()),
                    "fp": pa.array([signed(majority(s)) for s in sets], pa.int64()),
                    "more": pa.array([signed(majority(remixed(s))) for s in sets], pa.int64()),
                })

    return docs.mapInArrow(make, "doc_id long, text_key string, set_key binary, size int, fp long, more long")


def compared(sets: list[np.ndarray], bits: list[np.ndarray], radius: int, t: float, first: int | None = None) -> np.ndarray:
    """The group of each set over links of at most ``radius`` bits and a similarity of ``t`` at least.

    With ``first``, pairs of sets that both come at that place or later needn't be compared.
    """
    size = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    numbers, flat = np.unique(np.concatenate([np.empty(0, "<u8"), *sets]), return_inverse=True)
    starts = np.r_[0, np.cumsum(size)]
    group = np.arange(len(sets))
    left = np.ones(len(sets), dtype=bool)
    marked = np.zeros(len(numbers), dtype=bool)
    for begin in range(len(sets)):
        if first is not None and begin >= first:
            break
        if not left[begin]:
            continue
        todo = [begin]
        left[begin] = False
        while todo:
            at = todo.pop()
            apart = sum(np.bitwise_count(w ^ w[at]).astype(np.int64) for w in bits)
            may = left & (apart <= radius) & (np.minimum(size, size[at]) >= np.maximum(size, size[at]) * t - SLACK)
            if first is not None and at >= first:
                may[first:] = False
            if not may.any():
                continue
            mine = flat[starts[at] : starts[at + 1]]
            marked[mine] = True
            of = may[owner]
            shared = np.bincount(owner[of], weights=marked[flat[of]], minlength=len(sets))
            marked[mine] = False
            near = np.flatnonzero(may & (shared * (1 + t) >= (size + size[at]) * t - SLACK))
            group = merged(group, np.full(len(near), at), near)
            left[near] = False
            todo += near.tolist()
    return group


def _exact(dealt: DataFrame, by: list[str], words: int, radius: int, t: float) -> DataFrame:
    """``(a, b)``: links that connect the similar of ``dealt (part, node, size, fp, more, text, given)`` in each group.

    Only members of one part are compared; those that are ``given`` are compared with all, the others only with these
    unless none is given.
    """

    def compare(table: pa.Table) -> pa.Table:
        parts, nodes, given = (table.column(c).to_numpy(zero_copy_only=False) for c in ("part", "node", "given"))
        order = np.lexsort((nodes, ~given, parts))
        texts = table.column("text")
        bits = [table.column(w).to_numpy().view(np.uint64) for w in WORDS]
        a, b = [], []
        for own in np.split(order, np.flatnonzero(np.diff(parts[order])) + 1) if len(order) else []:
            sets = [shingle_set(texts[int(i)].as_py(), words) for i in own]
            first = int(given[own].sum()) or None
            group = compared(sets, [w[own] for w in bits], radius, t, first)
            moved = np.flatnonzero(group != np.arange(len(own)))
            a += nodes[own[moved]].tolist()
            b += nodes[own[group[moved]]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy(*by).applyInArrow(compare, "a long, b long")


def similar(entries: DataFrame, bundles: DataFrame, docs: DataFrame, words: int, radius: int, t: float, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: links that connect the similar ``entries`` of each of the ``bundles (node, component_id)``."""
    wanted = entries.join(bundles, "node").select("node", F.col("component_id").alias("part"), "size", *WORDS, F.col("id").alias("_id"), F.col("text_key").alias("_key"))
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_id"]) & (docs["text_key"] == wanted["_key"]))
    texts = stored(texts.select("part", "node", "size", *WORDS, "text").dropDuplicates(["node"]))
    shingles = F.sum(F.col("size").cast("long") + 1)
    sums = texts.groupBy("part").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(shingles / BLOCK_SHINGLES)).cast("int").alias("blocks"), shingles.alias("shingles"))
    sums = stored(sums)
    members = texts.join(sums, "part")
    total = sums.where("blocks = 1").agg(F.sum("shingles")).first()[0] or 0
    shares = max(1, -(-total // BLOCK_SHINGLES))
    few = members.where("blocks = 1").withColumn("given", F.lit(False)).withColumn("share", F.pmod(F.xxhash64("part"), F.lit(shares)))
    found = _exact(few.select("share", "part", "node", "size", *WORDS, "text", "given"), ["share"], words, radius, t)
    if sums.where("blocks > 1").isEmpty():
        return found
    # large bundles: each block in itself and with the pivots
    big = members.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    big = stored(big.select("part", "node", "size", *WORDS, "text", "blocks", "block"))
    pivots = big.groupBy("part").agg(F.slice(F.array_sort(F.collect_set(F.when(F.col("block") == 0, F.struct(F.hash("node").alias("h"), "node")))), 1, PIVOTS).alias("p"))
    pivots = big.join(pivots.select(F.explode("p.node").alias("node")), "node", "left_semi").withColumn("block", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)))
    round1 = big.unionByName(pivots).withColumn("given", F.lit(False))
    found = stored(found.unionByName(_exact(round1.drop("blocks"), ["part", "block"], words, radius, t)))
    # then what isn't in the largest group of its bundle with all of it
    parts = connected_components(found, "a", "b")
    grouped = big.select("part", "node", "blocks", "block").join(parts, "node", "left").withColumn("own", F.coalesce("component_id", "node"))
    counts = grouped.groupBy("part", "own").agg(F.count("*").alias("n"))
    most = counts.groupBy("part").agg(F.max_by("own", F.struct("n", "own")).alias("most"))
    rest = stored(grouped.join(most, "part").where("own <> most").select("part", "node"))
    if rest.isEmpty():
        return found
    left = rest.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("lefts"))
    all_of = big.join(left, "part").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))).withColumn("given", F.lit(False))
    some = big.join(left, "part").join(rest, ["part", "node"], "left_semi").withColumn("lot", F.pmod(F.xxhash64("node", F.lit(1)), F.col("lefts")).cast("int"))
    some = some.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("given", F.lit(True))
    round2 = all_of.unionByName(some).drop("blocks", "lefts")
    return found.unionByName(_exact(round2, ["part", "block", "lot"], words, radius, t))


def groups(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 26, segments: int = 9, share: int = SHARE, block: int = BLOCK
) -> DataFrame:
    """``(doc_id, text_key, node, part)``: for each row of ``docs (doc_id, text)``, the group that it is in.

    Rows are in one group that can be reached over links (see the module), or of one doc_id. Rows without words are
    alike; a null text counts as empty; rows with a null doc_id are linked like others. ``text_key`` is of the text,
    ``node`` of the set of shingles. An empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("text_key", F.md5("text"))
    made = stored(_rows(docs, words))
    first = F.min_by(F.struct("doc_id", "text_key"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    entries = made.groupBy("set_key").agg(first.alias("f"), *[F.first(c).alias(c) for c in ("size", *WORDS)])
    entries = entries.select("set_key", F.col("f.doc_id").alias("id"), F.col("f.text_key").alias("text_key"), "size", *WORDS)
    entries = stored(entries.withColumn("node", F.monotonically_increasing_id()))
    met = links(entries.select(F.col("node").alias("id"), "size", *WORDS), radius, segments, WORDS, similarity - SLACK, share)
    near = stored(similar(entries, connected_components(met, "a", "b"), docs, words, radius, similarity, block))
    nodes = stored(made.select("doc_id", "text_key", "set_key").join(entries.select("set_key", "node"), "set_key").drop("set_key"))
    one = nodes.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n"))
    one = nodes.join(one.where("a <> b").select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    parts = connected_components(near.unionByName(one), "a", "b").select("node", F.col("component_id").alias("part"))
    return nodes.join(parts, "node", "left").select("doc_id", "text_key", "node", F.coalesce("part", "node").alias("part"))


def keep_one_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, with all columns, of the smallest doc_id of each group; see groups.

    Rows with one doc_id are one document, of which a single row stays; of a group of which no row has a doc_id, one row.
    """
    made = stored(groups(docs, **how))
    best = stored(made.groupBy("part").agg(F.min("doc_id").alias("doc_id"), F.min("text_key").alias("_key")))
    named = docs.join(best.where("doc_id is not null").select("doc_id"), "doc_id", "left_semi")
    if not made.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        named = named.dropDuplicates(["doc_id"])
    lone = best.where("doc_id is null").select("_key")
    if lone.isEmpty():
        return named
    key = F.md5(F.coalesce("text", F.lit("")))
    picked = docs.where("doc_id is null").join(lone, key == lone["_key"], "left_semi").select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), key.alias("_key"))
    one = picked.groupBy("_key").agg(F.first("row").alias("row")).select("row.*")
    return named.select(*[f"`{c}`" for c in docs.columns]).unionByName(one)

"""SimHash near-duplicates by multi-index hashing.

A fingerprint of one or two 64-bit words is cut into segments. Two fingerprints within ``radius`` bits differ by few bits
in at least one segment (pigeonhole). Each fingerprint enumerates the small Hamming ball around each of its segments;
fingerprints meet in the table of a segment at the values that lie in the balls of both, and the complete distance is
verified. A ball of half the segment's radius is enough on either side: two values at most 2 bits apart share one that is
at most one bit from both. Equal fingerprints are one entry.

A table is dealt out by the leading bits of its segment, so that a task holds a share of bounded size, enumerates the
rest of the balls itself and meets there all that is in its share; a share that is too large (a hot group) is cut into
blocks, of which each pair is a task. A task returns only links that connect what it has found, one for an entry at
most, so that a group of n near copies gives in the order of n links, however many pairs it has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, only, stored
from kinmatch.operators.components import connected_components

BITS = 64
SHINGLE_SEED = 42
#: Entries of a share of a table that a task takes, about; and leading bits by which a table is dealt out, at least.
SHARE, LEAST_PREFIX = 1 << 18, 4
#: Members of a bucket from which a common group of most of them is told from the others.
CROWD = 256
#: Pairs that are held before they are joined to groups.
HELD = 1 << 20


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The XXH64 of each shingle, repeats included; of the whole word sequence where it is shorter than a shingle."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, dtype="<u8")
    shingles = zip(*(parts[i:] for i in range(words))) if len(parts) >= words else [parts]
    join, digest = b" ".join, xxhash.xxh64_intdigest
    return np.fromiter((digest(join(s), SHINGLE_SEED) for s in shingles), dtype="<u8")


def remixed(hashes: np.ndarray) -> np.ndarray:
    """Further 64 bits from each hash (the finaliser of splitmix64)."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half the hashes; 0 for none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of a text, unsigned; 0 for a text without words."""
    return majority(shingle_hashes(text, words))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint of each row's whole text as a signed long; a null text counts as empty."""

    def make():
        def each(batch):
            return {"doc_id": batch["doc_id"], "fp": [signed(fingerprint(t, words)) for t in batch["text"]]}

        return each

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "fp")])
    return map_arrow(only(docs, doc_id="long", text="string"), make, schema)


def plan_segments(radius: int, segments: int, words: int = 1) -> list[tuple[int, int, int, int]]:
    """(word, shift, width, ball) of each segment that needs a table, by the pigeonhole principle.

    The radii r of the segments are such that fingerprints within the radius differ by r bits at most in one of them:
    the sum of all r + 1 exceeds the radius. ``ball`` is half of r, rounded up. A segment lies within one word.
    """
    if radius < 0 or words not in (1, 2) or not words <= segments <= words * BITS:
        raise ValueError("radius, segments or words are out of range")
    share = [segments // words + (i < segments % words) for i in range(words)]
    widths = [(w, BITS // n + (i < BITS % n)) for w, n in enumerate(share) for i in range(n)]
    near, rest = divmod(radius, segments)
    out, used = [], [0] * words
    for i, (word, width) in enumerate(widths):
        used[word] += width
        r = near if i <= rest else near - 1
        if r >= 0:
            out.append((word, BITS - used[word], width, (r + 1) // 2))
    if any(ball > 1 for *_, ball in out):
        raise ValueError("segments whose radius is over 2 aren't provided for: take more segments")
    return out


def merged(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The group of each element, named by its least one, after a and b have been linked."""
    while len(a):
        x, y = group[a], group[b]
        new = x != y
        if not new.any():
            break
        a, b, x, y = a[new], b[new], x[new], y[new]
        to = np.arange(len(group))
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = to[to]
            if (further == to).all():
                break
            to = further
        group = to[group]
    return group


def meet(key: np.ndarray, size: np.ndarray, words: list[np.ndarray], at: np.ndarray, radius: int, ratio: float) -> np.ndarray:
    """The group of each entry, after all within the radius that share a key have been linked.

    ``at`` is the entry that has each key. Entries whose sizes are in a smaller ratio aren't linked. Members of a bucket
    are compared by growing distance in the order of sizes; groups found so far are left out of further comparison.
    """
    group = np.arange(len(size))
    order = np.lexsort((size[at], key))
    key, at = key[order], at[order]
    sizes = size[at]
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(words[0][a] ^ words[0][b])
        for w in words[1:]:
            apart = apart + np.bitwise_count(w[a] ^ w[b])
        return apart <= radius

    def join() -> None:
        nonlocal group, held
        if held:
            group = merged(group, *(np.concatenate(x) for x in zip(*held)))
            held = []

    alive, apart, due = np.arange(len(key)), 1, 1
    while True:
        alive = alive[alive + apart < len(key)]
        there = alive + apart
        alive = alive[(key[alive] == key[there]) & (sizes[alive] >= sizes[there] * ratio)]
        if not len(alive):
            break
        a, b = at[alive], at[alive + apart]
        other = group[a] != group[b]
        a, b = a[other], b[other]
        found = near(a, b)
        if found.any():
            held.append((a[found], b[found]))
        if apart == due or sum(len(x) for x, _ in held) > HELD:
            join()
            due = 2 * apart if apart == due else due
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            bucket = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
            of = group[at]
            mixed = np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts)
            alive = alive[mixed[bucket[alive]]]
            length = np.diff(np.r_[starts, len(key)])
            for k in np.unique(bucket[alive][length[bucket[alive]] > CROWD]):
                lo, hi = starts[k], starts[k] + length[k]
                names, counts = np.unique(of[lo:hi], return_counts=True)
                if 2 * counts.max() < hi - lo:
                    continue
                # most are one group: what isn't is compared with all, and the bucket is done
                for i in lo + np.flatnonzero(of[lo:hi] != names[counts.argmax()]):
                    first = lo + np.searchsorted(sizes[lo:hi], sizes[i] * ratio, "left")
                    last = lo + np.searchsorted(sizes[lo:hi], sizes[i] / ratio if ratio else np.inf, "right")
                    b = at[first:last]
                    b = b[group[b] != group[at[i]]]
                    b = b[near(np.full(len(b), at[i]), b)]
                    held.append((np.full(len(b), at[i]), b))
                    if sum(len(x) for x, _ in held) > HELD:
                        join()
                alive = alive[bucket[alive] != k]
        apart += 1
    join()
    return group


def links(
    entries: DataFrame, radius: int = 2, segments: int = 2, words: tuple[str, ...] = ("fp",), ratio: float = 0.0, share: int = SHARE
) -> DataFrame:
    """``(a, b)``: links that connect all of ``entries (id, size, *words)`` within the radius; b is the lesser id.

    Within it are entries with at most ``radius`` differing bits in all words together. Those whose sizes are in a smaller
    ratio than ``ratio`` aren't linked. Two such entries are in one group over the links returned; an entry is linked to
    the least of those that a task has found to be connected, which needn't be within the radius itself.
    """
    tables = plan_segments(radius, segments, len(words))
    count = entries.count()
    prefix = LEAST_PREFIX
    while count * (prefix + 1) > share << prefix and prefix < min(24, *(width for *_, width, _ in tables)):
        prefix += 1

    def places(i: int, word: int, shift: int, width: int, ball: int):
        """The shares of a table that hold some of the ball: the own one, and those that differ in a leading bit."""
        lead = F.shiftrightunsigned(words[word], shift + width - prefix).bitwiseAND(F.lit((1 << prefix) - 1).cast("long"))
        masks = [0, *(1 << k for k in range(prefix))] if ball else [0]
        return [F.struct(F.lit(i).alias("segment"), lead.bitwiseXOR(F.lit(m).cast("long")).cast("int").alias("lead")) for m in masks]

    dealt = entries.select(F.explode(F.array(*[p for i, t in enumerate(tables) for p in places(i, *t)])).alias("s"), "id", "size", *words)
    dealt = dealt.select("s.segment", "s.lead", "id", "size", *words)
    full = stored(dealt.groupBy("segment", "lead").agg(F.count("*").alias("n")).where(F.col("n") > share))
    whole = dealt.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    if not full.isEmpty():
        whole = whole.join(full.select("segment", "lead"), ["segment", "lead"], "left_anti")
        blocks = F.ceil(F.col("n") * 2 / share).cast("int")
        cut = dealt.join(full, ["segment", "lead"]).withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
        cut = cut.withColumn("other", F.explode(others)).where("other.i < other.j")
        whole = whole.unionByName(cut.select("segment", "lead", "id", "size", *words, "other.i", "other.j"))

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        by = np.argsort(ids, kind="stable")
        ids, size = ids[by], table.column("size").to_numpy()[by]
        bits = [table.column(w).to_numpy()[by].view(np.uint64) for w in words]  # bits of negative numbers count differently
        word, shift, width, ball = tables[table.column("segment")[0].as_py()]
        low, lead = width - prefix, table.column("lead")[0].as_py()
        value = (bits[word] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        own = np.flatnonzero((value >> np.uint64(low)) == lead)
        rest = np.flatnonzero((value >> np.uint64(low)) != lead)
        value = value & np.uint64((1 << low) - 1)
        masks = [0, *(1 << k for k in range(low))] if ball else [0]
        key = np.concatenate([value[rest], *(value[own] ^ np.uint64(m) for m in masks)])
        group = meet(key, size, bits, np.concatenate([rest, *([own] * len(masks))]), radius, ratio)
        moved = np.flatnonzero(group != np.arange(len(group)))
        return pa.table({"a": pa.array(ids[moved]), "b": pa.array(ids[group[moved]])})

    return whole.groupBy("segment", "lead", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3, segments: int = 2, share: int = SHARE) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs (doc_id, text)``.

    ``fingerprint`` is 16 hex digits; ``component_id`` the smallest doc_id that can be reached over links of at most
    ``radius`` differing bits, the row's own included. A null or empty text has fingerprint zero and is linked like any
    other; rows with one fingerprint share a component; a repeated doc_id gives a row each time; rows with a null doc_id
    are linked like others and bridge them, their component_id is null only if no member of it has a doc_id. An empty
    table gives an empty one.
    """
    made = stored(fingerprints(docs, words))
    entries = made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    entries = stored(entries.withColumn("id", F.monotonically_increasing_id()).withColumn("size", F.lit(1)))
    parts = stored(connected_components(links(entries, radius, segments, share=share), "a", "b").withColumnRenamed("node", "id"))
    linked = entries.join(parts, "id").select("fp", "least", F.col("component_id").alias("part"))
    leasts = linked.groupBy("part").agg(F.min("least").alias("component_id"))
    linked = linked.join(leasts, "part").select("fp", "component_id")
    alone = entries.join(parts, "id", "left_anti").select("fp", F.col("least").alias("component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return made.join(linked.unionByName(alone), "fp").select("doc_id", digits.alias("fingerprint"), "component_id")

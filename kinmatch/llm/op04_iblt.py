"""Document fingerprints as invertible Bloom lookup tables, in DataFrame functions only.

A text's paragraphs (its lines, in parts that end where their content says so) are hashed into cells that hold a count, the exclusive
or of the digests and that of their check sums (Eppstein et al., SIGCOMM 2011). Two texts' tables subtract cell by cell,
what they share cancels out, and peeling recovers the digests that only one of them has: a cell with one digest gives it
away, and taking it out of its other cells opens further ones. If that fails, larger tables are made of both and tried
again, with other cells each time, until all digests are recovered. The likeness is computed from the recovered digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: A text of fewer code points than this is cut at blanks, into parts of at least and at most so many code points.
SHORT, SHORT_PART = 512, (12, 48)
#: A longer one is cut at ends of its content, into parts of at least and at most so many code points.
PART = (48, 320)


def _marks() -> str:
    """A pattern's class of four code points of each 32, from U+0020 to U+2FFF, in blocks.

    A class of many ranges is tried range by range for each code point; in blocks only those of its own block are, and
    ASCII, listed singly, is looked up in one table.
    """
    code = lambda c: f"\\u{c:04x}"
    ascii_ = "".join(code(c + i) for c in range(0x20, 0x80, 32) for i in range(4))
    ranges = lambda at, to: "".join(f"{code(c)}-{code(c + 3)}" for c in range(at, to, 32))
    edges = [0x80, *range(0x200, 0x3001, 0x200)]
    blocks = "".join(f"[[{code(a)}-{code(b - 1)}]&&[{ranges(a, b)}]]" for a, b in zip(edges, edges[1:]))
    return f"[{ascii_}{blocks}]"


#: Ends of content: a blank after one of four code points of each 32, a full stop or the like of scripts without blanks,
#: and some pairs of a digit and a letter for texts without any of these.
ENDS = f"(?:[ \\t](?<={_marks()}.)|[\u3002\uff01\uff1f]|[0-3](?=[A-Ca-c]))"
#: Cells a hash function addresses: in the fingerprint, and in the tables of the retries one after another.
CELLS, RETRY_CELLS = 8, (8, 16, 16, 16, 16, 16, 16, 16)
#: Digests of both texts that a table of the retries is made for, on average at most.
A_TABLE = 8
ROUNDS = 24


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a value, so that it is computed once."""
    return F.transform(F.array(value), body)[0]


def _runs(starts: Column, size: Column, body: Callable[[Column, Column], Column]) -> Column:
    """For each of the runs that begin at ``starts`` in an array of ``size``: ``body`` of its start and its length."""
    return F.transform(starts, lambda at, j: body(at, F.coalesce(F.get(starts, j + 1), size) - at))


def _starts(sorted_: Column, of: Callable[[Column], Column]) -> Column:
    """Where in a sorted array each run of equal ``of(element)`` begins."""
    every = F.when(F.size(sorted_) > 0, F.sequence(F.lit(0), F.size(sorted_) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: (i == 0) | (of(F.get(sorted_, i - 1)) != of(F.get(sorted_, i))))


def pattern(part: tuple[int, int], ends: str) -> str:
    """Parts of lines: up to the first end after the least length, or of the greatest length where there is none."""
    least, most = part
    return f"[^\n]{{{least},{most - 1}}}?{ends}|[^\n]{{1,{most}}}"


def digests(text: Column) -> Column:
    """The digests of a text's paragraphs; a paragraph's n-th occurrence has a digest of its own. Linear but for a sort.

    Where a part ends depends on the code points before it back to its beginning, and beginnings fall into step again
    after something was put in or taken out. Texts on either side of ``SHORT`` have few parts in common.
    """
    parts = lambda part, ends: F.regexp_extract_all(text, F.lit(pattern(part, ends)), F.lit(0))
    cut = F.when(F.length(text) < SHORT, parts(SHORT_PART, "[ \\t]")).otherwise(parts(PART, ENDS))
    hashed = F.transform(cut, lambda p: F.xxhash64(p))

    def numbered(all_: Column) -> Column:
        each = lambda at, n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.get(all_, at), i))
        return F.flatten(_let(_starts(all_, lambda x: x), lambda starts: _runs(starts, F.size(all_), each)))

    return _let(F.array_sort(hashed), numbered)


def _item(digest: Column, sign: Column, level: Column, cells: int) -> Column:
    """A digest with its check sum and the bits of its three cells."""
    bits = {8: 3, 16: 4}[cells]
    one = F.lit(1).cast("long")

    def made(h: Column) -> Column:
        at = lambda r: F.shiftrightunsigned(h, r * bits).bitwiseAND(F.lit(cells - 1).cast("long")).cast("int") + r * cells
        mask = F.call_function("shiftleft", one, at(0))
        for r in (1, 2):
            mask = mask.bitwiseOR(F.call_function("shiftleft", one, at(r)))
        return F.struct(sign.alias("n"), digest.alias("k"), _check(digest).alias("h"), mask.alias("m"))

    return _let(F.xxhash64(digest, level), made)


def _check(digest: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(digest, F.lit("check")), 32)


def _in_cell(x: Column, bit: Column) -> Column:
    return x["m"].bitwiseAND(bit) != 0


def _bits(cells: int) -> Column:
    """The bit of each cell."""
    return F.array(*[F.lit(1 << i).cast("long") for i in range(3 * cells)])


def _cell(n: Column, k: Column, h: Column) -> Column:
    return F.struct(n.alias("n"), k.alias("k"), h.alias("h"))


def _table(items: Column, cells: int) -> Column:
    """The cells of a table of items."""
    zero = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    add = lambda a, x: _cell(a["n"] + x["n"], a["k"].bitwiseXOR(x["k"]), a["h"].bitwiseXOR(x["h"]))
    return _let(items, lambda all_: F.transform(_bits(cells), lambda bit: F.aggregate(F.filter(all_, lambda x: _in_cell(x, bit)), zero, add)))


def _peel(table: Column, level: Column, cells: int) -> Column:
    """The digests that a table of differences held, those of the first text and those of the second; null on failure."""
    sole = lambda c: (F.abs(c["n"]) == 1) & (c["h"] == _check(c["k"]))
    take = lambda a, p: _cell(a["n"] - p["n"], a["k"].bitwiseXOR(p["k"]), a["h"].bitwiseXOR(p["h"]))
    state = lambda cells_, found, going: F.struct(cells_.alias("c"), found.alias("found"), going.alias("going"))
    told = lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k"))

    left = lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["h"] != 0)

    def step(s: Column, _: Column) -> Column:
        pure = F.transform(F.filter(s["c"], sole), lambda c: _item(c["k"], c["n"], level, cells))
        rest = lambda p: F.zip_with(s["c"], _bits(cells), lambda c, bit: F.aggregate(F.filter(p, lambda x: _in_cell(x, bit)), c, take))
        after = lambda p: _let(rest(p), lambda c: state(c, F.concat(s["found"], F.transform(p, told)), F.exists(c, left)))
        stuck = state(s["c"], s["found"], F.lit(False))
        return F.when(~s["going"], s).otherwise(_let(F.array_distinct(pure), lambda p: F.when(F.size(p) == 0, stuck).otherwise(after(p))))

    none = F.array().cast("array<struct<n:int,k:bigint>>")
    begun = _let(table, lambda c: state(c, none, F.exists(c, left)))
    rounds = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), begun, step)
    return _let(rounds, lambda s: F.when(~F.exists(s["c"], left), _sides(s["found"])))


def _sides(found: Column) -> Column:
    of = lambda n: F.transform(F.filter(found, lambda x: x["n"] == n), lambda x: x["k"])
    return F.struct(of(1).alias("first"), of(-1).alias("second"))


def sketch(found: Column) -> Column:
    """The cells of a fingerprint, from digests."""
    return _table(F.transform(found, lambda d: _item(d, F.lit(1), F.lit(0), CELLS)), CELLS)


def as_text(cells: Column) -> Column:
    """A fingerprint's cells in hexadecimal digits: 4 of the count, 16 of the digests, 8 of the check sums."""
    digits = lambda c, n: F.lower(F.right(F.lpad(F.hex(c), 16, "0"), F.lit(n)))
    one = lambda c: F.concat(digits(c["n"].cast("long"), 4), digits(c["k"], 16), digits(c["h"], 8))
    return F.array_join(F.transform(cells, one), "")


def _retry(a: Column, b: Column) -> Column:
    """The digests that only one text has, from as many tables as hold few each; null on failure.

    Digests are dealt to tables by a hash, and sorted by table once. A table that can't be peeled is made again, larger
    and with other cells, from its own slice. Linear but for the sort.
    """
    dealt = F.greatest(F.lit(1.0), (F.size(a) + F.size(b)) / F.lit(A_TABLE))
    tables = F.pow(F.lit(2.0), F.least(F.lit(31.0), F.ceil(F.log2(dealt)))).cast("long")
    signed = lambda x, n: F.transform(x, lambda d: F.struct(F.lit(n).alias("n"), d.alias("k")))
    index = (1 << 32) - 1

    def recovered(n: Column, both: Column) -> Column:
        place = lambda x, i: F.shiftleft(F.xxhash64(x["k"], F.lit("table")).bitwiseAND(n - 1), 32).bitwiseOR(i.cast("long"))

        def peeled(order: Column):
            def one(at: Column, length: Column) -> Column:
                own = F.transform(F.slice(order, at + 1, length), lambda x: F.get(both, x.bitwiseAND(F.lit(index).cast("long")).cast("int")))
                made = lambda x, level, cells: _peel(_table(F.transform(x, lambda y: _item(y["k"], y["n"], F.lit(level), cells)), cells), F.lit(level), cells)
                return _let(own, lambda x: F.coalesce(*[made(x, level, cells) for level, cells in enumerate(RETRY_CELLS, 1)]))

            return one

        table_of = lambda x: F.shiftrightunsigned(x, 32)
        ordered = F.sort_array(F.transform(both, place))
        each = _let(ordered, lambda order: _let(_starts(order, table_of), lambda starts: _runs(starts, F.size(order), peeled(order))))
        side = lambda made, name: F.flatten(F.transform(made, lambda x: x[name])).alias(name)
        return _let(each, lambda made: F.when(~F.exists(made, lambda x: x.isNull()), F.struct(side(made, "first"), side(made, "second"))))

    return _let(tables, lambda n: _let(F.concat(signed(a, 1), signed(b, -1)), lambda both: recovered(n, both)))


def differing(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """The digests that only the first text has, and those that only the second has, recovered from their fingerprints.

    If the fingerprints' cells are too few for that, from larger tables made of both texts' digests.
    """
    less = F.zip_with(cells_a, cells_b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"])))
    first = _peel(less, F.lit(0), CELLS)
    return F.coalesce(first, _retry(a, b), F.raise_error(F.lit("digests that no table tells apart")).cast("struct<first:array<bigint>,second:array<bigint>>"))


def likeness(a: Column, b: Column, apart: Column) -> Column:
    """Of the paragraphs of two texts, the share that both have (Jaccard), from the digests that only one of them has."""
    total = F.size(a) + F.size(b)
    return _let(F.size(apart["first"]) + F.size(apart["second"]), lambda d: F.when(total == 0, F.lit(1.0)).otherwise((total - d) / (total + d)))


def _in_order(keys: DataFrame) -> DataFrame:
    """``(k, prev)`` of ``keys (k, doc_id, h, n)`` in order of doc_id and h, prev with k, doc_id and n; before the first is the last.

    Rows are dealt by ranges; only each range's ends are put in sequence by one task.
    """
    spread = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(keys.repartitionByRange(spread, "doc_id", "h").withColumn("part", F.spark_partition_id()))
    row = F.struct("k", "doc_id", "n")
    ends = dealt.groupBy("part").agg(F.max_by(row, F.struct("doc_id", "h")).alias("last"))
    w = Window.orderBy("part")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("last").over(w), F.last("last").over(every)).alias("before"))
    own = Window.partitionBy("part").orderBy("doc_id", "h")
    placed = dealt.select("part", "k", F.lag(row).over(own).alias("prev"))
    return placed.join(ends, "part").select("k", F.coalesce("prev", "before").alias("prev"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, edited, next_digests)`` for each document, with its edited text and the next one's digests.

    The edit replaces the last quarter of a text's code points, rounded down, by the first as many of the next document
    (or all it has), by ascending doc_id; after the last comes the first. A null text counts as empty; a null doc_id
    comes first; rows that agree in doc_id and text are one document and have a row each in the result, others of one
    doc_id go by their texts' hashes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.groupBy("doc_id").count().where("count > 1")
    if ids.isEmpty():
        keyed = rows.withColumn("k", F.col("doc_id").cast("string")).withColumn("copies", F.lit(1).cast("long"))
    else:
        keyed = rows.groupBy("doc_id", "text").agg(F.count("*").alias("copies")).withColumn("k", F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text")))
    keyed = keyed.withColumn("k", F.coalesce("k", F.lit("none")))
    order = _in_order(keyed.select("k", "doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n")))
    # both joins below read one shuffle of the texts; a row learns its doc_id, too, from the one after it
    texts = keyed.select("k", "text", "copies")
    sent = texts.drop("copies").join(order, "k").select(
        F.col("prev.k").alias("k"),
        F.col("prev.doc_id").alias("doc_id"),
        F.substring(F.col("text"), F.lit(1), F.floor(F.col("prev.n") / 4).cast("int")).alias("begin"),
        digests(F.col("text")).alias("next_digests"),
    )
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 4).cast("int")), F.col("begin"))
    made = texts.join(sent, "k").select("doc_id", "text", edited.alias("edited"), "next_digests", "copies")
    if not ids.isEmpty():
        made = made.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return made.drop("copies")


def fingerprints(pairs: DataFrame) -> DataFrame:
    """Fingerprints of texts and edited texts, their likeness to each other and to the next text's, and what differs.

    ``lost`` and ``gained`` are the digests of paragraphs that only the text, and only the edited text has. Equal texts
    have equal fingerprints; an empty text's has empty cells and is like another empty text's only.
    """
    three = F.array(digests(F.col("text")), digests(F.col("edited")), F.col("next_digests"))
    made = pairs.withColumn("made", F.transform(three, lambda d: F.struct(d.alias("d"), sketch(d).alias("cells"))))
    own = F.col("made")[0]

    def compared(m: Column) -> Column:
        return _let(differing(own["d"], m["d"], own["cells"], m["cells"]), lambda x: F.struct(likeness(own["d"], m["d"], x).alias("near"), x.alias("apart")))

    made = made.withColumn("near", F.transform(F.slice("made", 2, 2), compared))
    made = made.withColumn("prints", F.transform(F.slice("made", 1, 2), lambda m: as_text(m["cells"])))
    return made.select(
        "doc_id", "text", "edited",
        F.col("prints")[0].alias("fingerprint"), F.col("prints")[1].alias("edited_fingerprint"),
        F.col("near")[0]["near"].alias("near_edited"), F.col("near")[1]["near"].alias("near_next"),
        F.col("near")[0]["apart"]["first"].alias("lost"), F.col("near")[0]["apart"]["second"].alias("gained"),
    )

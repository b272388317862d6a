"""Source divergence audit by sort-based streaming.

Each language keeps the terms of at least ``least`` of its documents; each (language, source) group gives each kept term
a share in parts of a thousand million, p = 1 + floor(10^9 (count + 1) / (N + V)). Groups are compared with each other,
and terms with their language. All arithmetic is exact.

Two passes over sorted rows. In the first, a task adds up its own documents for each (language, term, source), so that a
frequent term or a hot source is a few rows a task; these partial rows are dealt by (language, term), sorted by language,
term and source within a task, and read in runs: a run has the document frequency and counts of a term. In the second,
what is kept of a language is dealt into slices of bounded size by term (and, if it has very many sources, into blocks of
sources); each slice begins with the language's groups and their totals, and its runs are added up into partial values
of pairs and the foremost terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import methodcaller

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, slices, stored

#: Runs of ASCII letters and all characters beyond ASCII, in UTF-8 whose ASCII letters are lower-cased.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Parts that a share is given in.
PARTS = 1_000_000_000
#: Terms that a task holds before it passes them on; bytes of a text from which its terms aren't listed at once.
HELD, LONG = 400_000, 1 << 20
#: Kept counts of a slice, at least; sources of a block; cells of the matrix of counts that is worked on at a time.
SLICE, BLOCK, CELLS = 1 << 14, 512, 1 << 20


def partial_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of each term in some of a group's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                yield pa.record_batch(
                    {
                        "lang": pa.array([lang] * len(terms), pa.string()),
                        "source": pa.array([source] * len(terms), pa.string()),
                        "term": pa.array(terms, pa.binary()),
                        "n": pa.array(n.values(), pa.int64()),
                        "docs": pa.array(map(docs.__getitem__, terms), pa.int64()),
                    }
                )
            held.clear()

        for batch in batches:
            for part in slices(batch):
                for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text"))):
                    n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                    before, low = len(n), text.lower()
                    terms = TERM.findall(low) if len(low) < LONG else Counter(map(methodcaller("group"), TERM.finditer(low)))
                    n.update(terms)
                    docs.update(set(terms))
                    size += len(n) - before
                    if size > HELD:
                        yield from passed_on()
                        size = 0
        yield from passed_on()

    return docs.mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def starts(*columns: pa.Array) -> np.ndarray:
    """Where runs of rows that are equal in all columns begin."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def kept_counts(partial: DataFrame, least: int) -> DataFrame:
    """``(lang, term, source, n, first)`` of the terms in at least ``least`` documents of a language; ``first`` is 1 in one row a term.

    A task holds a batch, and the sums of one term for each of the language's sources.
    """

    def summed(rows: pa.Table) -> pa.Table:
        at = starts(rows["source"], rows["term"], rows["lang"])
        sums = {c: pa.array(np.add.reduceat(rows[c].to_numpy(), at)) for c in ("n", "docs")}
        keys = rows.select(["lang", "term", "source"]).take(pa.array(at))
        return pa.table({**{c: keys[c].combine_chunks() for c in keys.column_names}, **sums})

    def told(rows: pa.Table) -> pa.Table:
        """The rows of whole terms that are kept."""
        at = starts(rows["term"].combine_chunks(), rows["lang"].combine_chunks())
        documents = np.add.reduceat(rows["docs"].to_numpy(), at)
        first = np.zeros(len(rows), dtype=np.int64)
        first[at] = 1
        keep = (documents >= least)[np.cumsum(first) - 1]
        return rows.drop_columns("docs").append_column("first", pa.array(first)).filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch]).select(["lang", "term", "source", "n", "docs"])
            rows = summed((pa.concat_tables([held, rows]) if held else rows).combine_chunks())
            whole = int(starts(rows["term"].combine_chunks(), rows["lang"].combine_chunks())[-1])
            if whole:
                yield from told(rows.slice(0, whole)).to_batches()
            held = rows.slice(whole)
        if held:
            yield from told(held).to_batches()

    dealt = partial.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(run, "lang string, term binary, source string, n long, first long")


def shares(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(PARTS (count + 1) / (total + terms)), by long division, as the product may not fit in 64 bits; divisors up to 9 x 10^17."""
    by = np.asarray(total, dtype=np.int64) + terms
    out, rest = np.divmod(count + 1, by)
    for _ in range(9):
        digit, rest = np.divmod(rest * 10, by)
        out = out * 10 + digit
    return out + 1


class _Slice:
    """Pairs and terms of one slice of a language and one block of its sources."""

    def __init__(self, top: int):
        self.top, self.names, self.own, self.n = top, [], [], []
        self.terms = self.total = 0
        self.place: dict[str, int] = {}
        self.pairs: np.ndarray | None = None
        self.best: list[list[tuple[int, bytes]]] = []
        self.terms_seen: list[bytes] = []
        self.cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def header(self, source: str, own: bool, n: int, terms: int, total: int) -> None:
        self.place[source] = len(self.names)
        if own:
            self.own.append(len(self.names))
        self.names.append(source)
        self.n.append(n)
        self.terms, self.total = terms, total

    def runs(self, term: pa.Array, source: pa.Array, n: np.ndarray) -> None:
        """Further rows, in which a term's are together; the first may go on with the last term before."""
        at = starts(term)
        terms = term.take(pa.array(at)).to_pylist()
        more = bool(self.terms_seen) and self.terms_seen[-1] == terms[0]
        if not more and len(self.terms_seen) * len(self.names) >= CELLS:
            self.add()
        row = len(self.terms_seen) - more + np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(term)]))
        self.terms_seen += terms[more:]
        coded = source.dictionary_encode()
        place = np.array([self.place[s] for s in coded.dictionary.to_pylist()])
        self.cells.append((row, place[coded.indices.to_numpy()], n))

    def add(self) -> None:
        """The values of the terms that wait; sums of a pair stay below (10^9 + V)^2 + 10^9 + V, which fits in 64 bits."""
        if self.pairs is None:  # all of the slice's groups have been read
            self.pairs = np.zeros((len(self.own), len(self.names)), dtype=np.int64)
            self.best = [[] for _ in self.own]
        count = np.zeros((len(self.terms_seen), len(self.names)), dtype=np.int64)
        for row, place, n in self.cells:
            count[row, place] = n
        p = shares(count, self.n, self.terms)
        q = shares(count.sum(axis=1), self.total, self.terms)
        for k, i in enumerate(self.own):
            apart = p[:, i : i + 1] - p
            self.pairs[k] += (apart * apart // p).sum(axis=0)
            more = np.flatnonzero((count[:, i] > 0) & (p[:, i] > q))
            value = (p[more, i] - q[more]) ** 2 // q[more]
            best = self.best[k]
            best.extend((-v, self.terms_seen[j]) for v, j in zip(value.tolist(), more.tolist()))
            best.sort()
            del best[self.top :]
        self.terms_seen, self.cells = [], []

    def rows(self) -> Iterator[tuple[str, str, bytes, int]]:
        self.add()
        for k, i in enumerate(self.own):
            name = self.names[i]
            yield from ((name, "pair", s.encode(), v) for j, (s, v) in enumerate(zip(self.names, self.pairs[k].tolist())) if j != i)
            yield from ((name, "term", term, -v) for v, term in self.best[k])


def partial_values(dealt: DataFrame, top: int) -> DataFrame:
    """``(lang, source, part, item, value)`` of each slice and block, from rows sorted so that a slice begins with its groups."""

    def values(lang: str, now: _Slice) -> Iterator[pa.RecordBatch]:
        if rows := list(now.rows()):
            source, part, item, value = zip(*rows)
            yield pa.record_batch(
                {
                    "lang": pa.array([lang] * len(rows), pa.string()),
                    "source": pa.array(source, pa.string()),
                    "part": pa.array(part, pa.string()),
                    "item": pa.array(item, pa.binary()),
                    "value": pa.array(value, pa.int64()),
                }
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, now = None, None
        for batch in batches:
            keys = [batch.column(c) for c in ("lang", "slice", "block")]
            at = starts(*keys)
            for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(batch)]):
                key = tuple(k[lo].as_py() for k in keys)
                if key != where:
                    if now is not None:
                        yield from values(where[0], now)
                    where, now = key, _Slice(top)
                part = batch.slice(lo, hi - lo)
                groups = part.column("term").null_count
                if groups:
                    for row in part.slice(0, groups).select(["source", "own", "n", "terms", "total"]).to_pylist():
                        now.header(**row)
                if groups < len(part):
                    part = part.slice(groups)
                    now.runs(part.column("term"), part.column("source"), part.column("n").to_numpy())
        if now is not None:
            yield from values(where[0], now)

    return dealt.mapInArrow(run, "lang string, source string, part string, item binary, value long")


def audit(docs: DataFrame, least: int = 3, top: int = 200, rows: int = SLICE, block: int = BLOCK) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` over ``docs (text, lang, source)``; null values count as ''.

    ``pair``: each other source of the language, by how far the group's shares are from that source's, summed over all
    kept terms; 0 where the language keeps none. ``term``: each kept term that the group has and gives more than its
    language does, the first ``top``. Ranks are by falling value, then by the item's UTF-8. A repeated row counts each
    time, as a document of its own; a group without terms has its pairs; an empty table gives no rows; a language with
    one source has no pairs. ``rows`` and ``block`` bound a slice and its sources and change no result.
    """
    read = only(docs, text="binary", lang="string", source="string")
    read = read.select(*[F.coalesce(c, F.lit("").cast(kind)).alias(c) for c, kind in (("text", "binary"), ("lang", "string"), ("source", "string"))])
    kept = stored(kept_counts(partial_counts(read), least))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("first"), F.count("*").alias("rows"))
    groups = read.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill(0, ["n", "first", "rows"])
    groups = stored(groups)
    langs = groups.groupBy("lang").agg(
        F.sum("first").alias("terms"), F.sum("n").alias("total"), F.sum("rows").alias("rows"), F.count("*").alias("sources")
    )
    held = F.greatest(F.lit(rows).cast("long"), 4 * F.col("sources") * F.col("sources"))  # partial pairs stay fewer than counts
    langs = stored(
        langs.select(
            "lang",
            "terms",
            "total",
            F.greatest(F.lit(1), F.ceil(F.col("rows") / held)).cast("int").alias("slices"),
            F.ceil(F.col("sources") / block).cast("int").alias("blocks"),
        )
    )

    def upto(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    own = F.pmod(F.xxhash64("source"), F.col("blocks")) == F.col("block")
    headers = groups.join(langs, "lang").withColumn("slice", upto("slices")).withColumn("block", upto("blocks"))
    headers = headers.select("lang", "slice", "block", F.lit(None).cast("binary").alias("term"), "source", "n", own.alias("own"), "terms", "total")
    counts = kept.join(langs, "lang").withColumn("block", upto("blocks"))
    cut = F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice")
    counts = counts.select("lang", cut, "block", "term", "source", "n", F.lit(False).alias("own"), F.lit(0).cast("long").alias("terms"), F.lit(0).cast("long").alias("total"))
    dealt = headers.unionByName(counts).repartition("lang", "slice", "block").sortWithinPartitions("lang", "slice", "block", "term", "source")
    made = stored(partial_values(dealt, top))
    pairs = made.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = made.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
    return ranked.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")

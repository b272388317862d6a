"""A store that is refreshed by ranges of row numbers: only ranges whose texts have changed are made again.

A digest of a range is a sum over its rows, and that of the whole store is the sum over its ranges: one pass over the
texts gives both, equal digests above need no look below, and a version refreshed range by range has the summary of one
that was written whole. A version is a table of ranges, each with the folder that holds its rows; folders of earlier
versions are used on, and copied together once there are many.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored
from .store import DIGESTS, Store, Summary, as_digest, digest_sums

#: Row numbers of a range; folders that a version may be spread over.
RANGE, FOLDERS = 4096, 16


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: the version that readers see now, and how many of its ranges were made and kept."""

    summary: Summary
    made: int
    kept: int


class RangedStore(Store):
    """As ``Store``, with ``refresh``; rows need ``row_no`` and a text, and a row without a number is in a range of its own kind."""

    def __init__(self, spark: SparkSession, path: str, size: int = RANGE, folders: int = FOLDERS):
        super().__init__(spark, path)
        self.size, self.folders = size, folders

    def _range(self) -> Column:
        return F.coalesce(F.floor((F.col("row_no") - 1) / self.size), F.lit(-1)).cast("long")

    def ranges(self) -> DataFrame:
        """``(range_no, n, dim, digests, folder)`` of the published version; FileNotFoundError before the first."""
        found = self.summary()
        if found is None:
            raise FileNotFoundError(f"no version below {self.path}")
        return self.spark.read.parquet(f"{self.path}/ranges={found.version}")

    def _columns(self) -> T.StructType:
        return self.spark.read.parquet(f"{self.path}/columns={self.summary().version}").schema

    def _rows(self, ranges: DataFrame) -> DataFrame | None:
        """The rows of the ranges named, each from its folder; other folders aren't opened."""
        folders = sorted(r[0] for r in ranges.select("folder").distinct().collect())  # as many as ``self.folders`` at most
        if not folders:  # a version without rows
            return None
        schema = T.StructType([*self._columns(), T.StructField("folder", T.StringType()), T.StructField("range_no", T.LongType())])
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/folder={f}" for f in folders])
        return rows.join(ranges.select("folder", "range_no"), ["folder", "range_no"], "left_semi")

    def read(self) -> DataFrame:
        """The rows of the published version; FileNotFoundError before the first."""
        ranges = self.ranges()
        rows = self._rows(ranges)
        if rows is None:
            return self.spark.createDataFrame([], self._columns())
        return rows.drop("folder", "range_no")

    def write(self, rows: DataFrame, model: str, vector: str = "embedding", text: str = "text") -> Summary:
        """A version of which all ranges are new; ``rows`` have their vectors."""
        return self.refresh(rows, model, lambda r: r, vector, text, force=True).summary

    def refresh(self, rows: DataFrame, model: str, make: Callable[[DataFrame], DataFrame], vector: str = "embedding", text: str = "text", force: bool = False) -> Refresh:
        """Publishes a version that fits ``rows``: ``make`` adds vectors to the rows of changed ranges only.

        A range is kept if the same model made it, with the same columns, and its rows' numbers and texts are the same;
        other columns come from when it was made. If nothing has changed there is no new version; if anything fails, the old one stays. A
        ``make`` that loses or adds rows, or makes vectors of two lengths, fails.
        """
        found = self.summary()
        placed = rows.withColumn("range_no", self._range())
        fresh = stored(placed.groupBy("range_no").agg(F.count("*").alias("n"), *digest_sums("row_no", text)))
        columns = make(placed).drop("range_no").schema
        if found is None or force or found.model != model or self._columns().simpleString() != columns.simpleString():
            kept, changed = None, fresh
        else:
            by = ["range_no", "n", *DIGESTS]
            old = self.ranges()
            kept = stored(old.join(fresh.select(*by), by, "left_semi"))
            changed = stored(fresh.join(old.select(*by), by, "left_anti"))
            if changed.isEmpty() and kept.count() == old.count():
                return Refresh(found, 0, kept.count())
        version = uuid.uuid4().hex
        staged = [self._file(f"{kind}={version}") for kind in ("folder", "ranges", "columns")]
        try:
            return self._refreshed(version, placed, changed, kept, model, make, vector)
        except Exception:
            for fs, path in staged:
                fs.delete(path, True)
            raise

    def _refreshed(self, version, placed, changed, kept, model, make, vector) -> Refresh:
        n_made, n_kept = changed.count(), 0 if kept is None else kept.count()
        # a filter on the few changed ranges is decided before texts are made into vectors
        made = make(placed.join(changed.select("range_no"), "range_no", "left_semi"))
        folder = f"{self.path}/folder={version}"
        if n_kept and kept.select("folder").distinct().count() + 1 > self.folders:
            copied = self._rows(kept)
            made = made.unionByName(copied.drop("folder").select(*made.columns))
            changed, kept = changed.unionByName(kept.select(*changed.columns)), None
        self.spark.createDataFrame([], made.drop("range_no").schema).coalesce(1).write.parquet(f"{self.path}/columns={version}")
        # ranges share files, in order within each: a file for each range would be as many as there are ranges
        made.repartition("range_no").sortWithinPartitions("range_no").write.parquet(folder)
        there = self.spark.read.schema(made.schema).parquet(folder).groupBy("range_no")
        there = there.agg(F.count("*").alias("found"), F.max(F.size(vector)).alias("dim"), F.min(F.size(vector)).alias("least"))
        of_new = stored(changed.join(there, "range_no", "left").withColumn("folder", F.lit(version)))
        lost = of_new.where("found IS NULL OR found <> n").first()
        if lost is not None:
            raise ValueError(f"range {lost['range_no']} has {lost['found'] or 0} of {lost['n']} rows")
        columns = ["range_no", "n", "dim", "least", *DIGESTS, "folder"]
        ranges = of_new.select(*columns)
        if kept is not None:
            ranges = ranges.unionByName(kept.select(*columns))
        ranges.coalesce(1).write.parquet(f"{self.path}/ranges={version}")
        whole = self.spark.read.schema(ranges.schema).parquet(f"{self.path}/ranges={version}")
        n, dim, least, *sums = whole.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("dim"), F.lit(0)), F.coalesce(F.min("least"), F.lit(0)), *[F.sum(c) for c in DIGESTS]).first()
        if dim != least:
            raise ValueError(f"vectors have {least} to {dim} components")
        summary = Summary(version, model, n, dim, as_digest(n, sums))
        self._publish(summary)
        return Refresh(summary, n_made, n_kept)

    def sweep(self, older_than_s: float) -> list[str]:
        """Deletes folders that the published version doesn't use and that are older than that; their names.

        The age is what readers under way, and writers that haven't published yet, are given.
        """
        found = self.summary()
        used = set() if found is None else {f"ranges={found.version}", f"columns={found.version}", *(f"folder={r[0]}" for r in self.ranges().select("folder").distinct().collect())}
        fs, here = self._file("")
        out = []
        for status in fs.listStatus(here) if fs.exists(here) else []:
            name = status.getPath().getName()
            old = time.time() * 1000 - status.getModificationTime() >= older_than_s * 1000
            if name.startswith(("folder=", "ranges=", "columns=")) and name not in used and old:
                fs.delete(status.getPath(), True)
                out.append(name)
        return sorted(out)


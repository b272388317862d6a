"""A versioned store of rows with their vectors: a version is written whole, then a pointer is moved to it."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Summary:
    """What is known of a version without reading it."""

    version: str
    model: str
    rows: int
    dim: int
    text_digest: str
    status: str = "complete"


#: Columns of ``digest_sums``.
DIGESTS = ("h0", "h1", "h2", "h3")


def digest_sums(row: str, text: str) -> list[Column]:
    """Sums over rows that make up a digest of their numbers and texts; those of parts add up to those of the whole."""
    h = F.sha2(F.concat_ws("\x1f", F.col(row).cast("string"), F.coalesce(F.col(text), F.lit(""))), 256)
    return [F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")).alias(name) for name, at in zip(DIGESTS, (1, 16, 31, 46))]


def as_digest(rows: int, sums) -> str:
    return "-".join(str(x or 0) for x in (rows, *sums))


def text_digest(df: DataFrame, row: str = "row_no", text: str = "text") -> str:
    """A digest of all texts and their row numbers; rows may be read in any order and are combined before the shuffle."""
    n, *sums = df.agg(F.count("*"), *digest_sums(row, text)).first()
    return as_digest(n, sums)


def mismatches(found: Summary | None, model: str, rows: int, digest: str | None = None) -> list[str]:
    """Why a version can't be used again; none if it can."""
    if found is None:
        return ["no version is there"]
    out = []
    if found.model != model:
        out.append(f"model is {found.model}, not {model}")
    if found.rows != rows:
        out.append(f"rows are {found.rows}, not {rows}")
    if digest is not None and found.text_digest != digest:
        out.append("texts have changed")
    if found.status != "complete":
        out.append(f"status is {found.status}")
    return out


def cache_action(found: Summary | None, model: str, rows: int, digest: str | None = None, force: bool = False) -> str:
    """What a writer would do with a version: ``reuse`` it, ``compute`` a new one, or find it ``missing``."""
    if force:
        return "compute"
    if found is None:
        return "missing"
    return "compute" if mismatches(found, model, rows, digest) else "reuse"


def guard(found: Summary | None, model: str, dim: int | None = None) -> Summary:
    """The version, if vectors of ``model`` with ``dim`` components can be compared with it; RuntimeError if not."""
    if found is None:
        raise RuntimeError("no version is published")
    if found.model != model:
        raise RuntimeError(f"vectors were made by {found.model}, not by {model}")
    if dim is not None and found.rows and found.dim != dim:
        raise RuntimeError(f"vectors have {found.dim} components, not {dim}")
    return found


class Store:
    """Versions below one path of any file system that Spark reaches; readers see a version whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, name: str):
        jvm, fs = self._fs()
        return fs, jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def summary(self) -> Summary | None:
        """Of the version that readers see; None before the first."""
        fs, current = self._file("CURRENT")
        if not fs.exists(current):
            return None
        return Summary(**json.loads(self.spark.read.text(f"{self.path}/CURRENT").first()[0]))

    def write(self, rows: DataFrame, model: str, vector: str = "embedding", text: str = "text") -> Summary:
        """Writes ``rows`` as a new version and publishes it; if that fails, it is deleted and the old one stays."""
        version = uuid.uuid4().hex
        fs, staged = self._file(f"v={version}")
        try:
            rows.write.parquet(staged.toString())
            kept = self.spark.read.parquet(staged.toString())
            n, dim, least = kept.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(0)), F.coalesce(F.min(F.size(vector)), F.lit(0))).first()
            if dim != least:
                raise ValueError(f"vectors have {least} to {dim} components")
            made = Summary(version, model, n, dim, text_digest(kept, text=text))
            self._publish(made)
        except Exception:
            fs.delete(staged, True)
            raise
        return made

    def _publish(self, made: Summary) -> None:
        fs, fresh = self._file(f"CURRENT.{made.version}")
        _, current = self._file("CURRENT")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(asdict(made)).encode()))
        out.close()
        jvm, _ = self._fs()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE  # readers see the old pointer or the new one
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(context.makeQualified(fresh), context.makeQualified(current), how)

    def read(self) -> DataFrame:
        """The rows of the published version; FileNotFoundError before the first."""
        found = self.summary()
        if found is None:
            raise FileNotFoundError(f"no version below {self.path}")
        return self.spark.read.parquet(f"{self.path}/v={found.version}")

    def reuse_or_write(self, rows: DataFrame, model: str, make, mode: str = "reuse_if_present") -> Summary:
        """The published version if it fits ``rows``, else a new one of ``make(rows)``; ``mode`` may be ``force_recompute`` or ``reuse_only``."""
        if mode not in ("reuse_if_present", "reuse_only", "force_recompute"):
            raise ValueError(mode)
        found = self.summary()
        why = mismatches(found, model, rows.count(), text_digest(rows))
        if mode != "force_recompute" and not why:
            return found
        if mode == "reuse_only":
            raise RuntimeError("; ".join(why))
        return self.write(make(rows), model)


#: Columns of records that aren't written out.
PRIVATE = ("_item_description", "_item_type", "_main_group", "_sub_group")


def without_private(records: DataFrame) -> DataFrame:
    return records.drop(*PRIVATE)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls written out."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json_arrays(rows: DataFrame, path: str) -> None:
    """Rows as JSON arrays, nulls written out: a file for each partition of ``rows``, each of them one array.

    Arrays are written by the executors a row at a time; whoever needs a single file coalesces the rows to one partition.
    A table without rows gives empty arrays, or an empty file where it has no partitions.
    """
    line = rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("line"))

    def bracketed(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            values = [("[" if first and i == 0 else ",") + v for i, v in enumerate(batch.column(0).to_pylist())]
            if values:
                first = False
                yield pa.RecordBatch.from_pydict({"value": pa.array(values, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": pa.array(["[]" if first else "]"], pa.string())})

    line.mapInArrow(bracketed, "value string").write.mode("overwrite").text(path)

"""Tables as sources: ordered scans with row numbers, column checks, JDBC, JSON lines and spreadsheets."""

from __future__ import annotations

import logging
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored

ITEM_COLUMNS = ("ITEM_TYPE", "MAINGROUP", "SUBGROUP", "ITEMDESC")
ITEM_EXTRAS = ("ITEM_CODE", "UOM", "Supplier")
VENDOR_COLUMNS = ("id", "Name", "CNIC", "NTN", "SalesTaxNo", "AccountNo", "IbanNO")
FETCH_ROWS = 5000

log = logging.getLogger(__name__)


def quoted(name: str) -> str:
    """A column's name in backticks; those inside it are doubled."""
    return "`" + name.replace("`", "``") + "`"


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns, in that order; KeyError if one is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df.select(*[F.col(quoted(c)) for c in columns])


def has_column(df: DataFrame, name: str) -> bool:
    """Whether a column exists, whatever the case of its letters."""
    return name.lower() in {c.lower() for c in df.columns}


def order_by(clause: str | None, df: DataFrame, fallback: Sequence[str] = ITEM_COLUMNS) -> list[Column]:
    """Sort columns for a clause such as ``id NULLS LAST`` or ``name DESC, id``; without one, by id or else the fallback.

    Nulls come last unless the clause says otherwise; quotes around a name, or a stray one after it, don't matter.
    """
    if not (clause or "").strip():
        names = ["id"] if has_column(df, "id") else list(fallback)
        return [F.col(quoted(c)).asc_nulls_last() for c in names]
    out = []
    for part in clause.split(","):
        m = re.fullmatch(r"\s*\"?([A-Za-z_][A-Za-z0-9_]*)\"?\s*(ASC|DESC)?\s*(?:NULLS\s+(FIRST|LAST))?\s*", part, re.I)
        if not m:
            raise ValueError(f"not a sort order: {part!r}")
        column, down, first = F.col(f"`{m[1]}`"), (m[2] or "").upper() == "DESC", (m[3] or "").upper() == "FIRST"
        kind = ("desc" if down else "asc") + ("_nulls_first" if first else "_nulls_last")
        out.append(getattr(column, kind)())
    return out


def with_row_no(df: DataFrame, order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """Numbers rows from 1 in the given order. Rows are dealt by ranges; one task only adds up the ranges' counts."""
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, own, skip, n = (f"_{x}_{uuid.uuid4().hex}" for x in ("part", "own", "skip", "n"))  # no column of the rows has such a name
    dealt = stored(df.repartitionByRange(spread, *order).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(part).agg(F.count("*").alias(n))
    before = F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = dealt.withColumn(own, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    numbered = numbered.join(F.broadcast(sizes.select(part, before.alias(skip))), part)
    return numbered.withColumn(name, (F.col(own) + F.col(skip)).cast("long")).drop(part, own, skip)


def _first(df: DataFrame, order: Sequence[Column], limit: int | None) -> DataFrame:
    """Numbered rows; of a limit, only the first rows of each partition are put in order and numbered."""
    return with_row_no(df if limit is None else df.orderBy(*order).limit(limit), order)


def item_rows(df: DataFrame, order: str | None = None, extras: bool = False, limit: int | None = None) -> DataFrame:
    """Item rows as texts with their row number, of four columns or, with ``extras``, of seven; the first ``limit`` if given."""
    names = ITEM_COLUMNS + (ITEM_EXTRAS if extras else ())
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return _first(df, order_by(order, df), limit).select("row_no", *[F.col(quoted(c)).cast("string").alias(c) for c in names])


def vendor_rows(df: DataFrame, order: str | None = None, limit: int | None = None) -> DataFrame:
    """Vendor rows with their row number, by id."""
    return _first(require(df, VENDOR_COLUMNS), order_by(order, df), limit)


def catalog_rows(df: DataFrame, text: str, id_: str = "id") -> DataFrame:
    """``(id, text)`` of a catalog: null ids are 0, a table without ids is numbered; null texts are empty, others stripped."""
    from ..functions.text import strip

    label = strip(F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))).alias("text")
    if has_column(df, id_):
        return df.select(F.coalesce(F.col(quoted(id_)).cast("long"), F.lit(0)).alias("id"), label)
    return with_row_no(df, order_by(None, df, [text]), "id").select("id", label)


def read_jdbc(spark: SparkSession, url: str, table: str, columns: Sequence[str], properties: dict[str, str], **split) -> DataFrame:
    """A database view; ``split`` may give partitionColumn, lowerBound, upperBound and numPartitions for a parallel read."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", FETCH_ROWS)
    for k, v in {**properties, **split}.items():
        reader = reader.option(k, v)
    return require(reader.load(), columns)


def read_json_lines(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Rows of texts from JSON lines; lines that are blank are skipped, others that can't be read are an error when read."""
    if not set(columns) & set(ITEM_COLUMNS):
        log.warning("none of the display columns is read from %s", path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0, limit: int | None = None) -> DataFrame:
    """A sheet as texts, without rows that are empty; needs a reader of spreadsheets for pandas."""
    import pandas as pd

    rows = pd.read_excel(path, sheet_name=sheet, dtype=str).dropna(how="all")
    rows = rows if limit is None else rows.head(limit)
    schema = T.StructType([T.StructField(str(c), T.StringType()) for c in rows.columns])
    return spark.createDataFrame(rows.astype(object).where(rows.notna(), None), schema)

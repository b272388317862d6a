"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kinmatch.sources.shared import durable, shared_dir, stored

__all__ = ["ARROW", "crc_mod5", "durable", "filter_arrow", "map_arrow", "only", "shared_dir", "stored"]


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns cast to the given types, so that further columns, whatever their names, don't get in the way."""
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()])


#: Arrow bytes whose rows are turned into Python values at a time, so that a batch isn't held twice.
SLICE_BYTES = 8_000_000


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE_BYTES, of a row at least."""
    step = max(1, int(len(batch) * SLICE_BYTES / max(1, batch.nbytes)))
    return (batch.slice(at, step) for at in range(0, len(batch), step))


def map_arrow(
    df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, Iterable]]], schema: T.StructType
) -> DataFrame:
    """Apply a function of Python lists, made once a task by ``make()``, to parts of each Arrow batch; ``schema`` is what it returns."""
    out = pa.schema([(f.name, ARROW.get(type(f.dataType)) or to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = None
        for batch in batches:
            each = each or make()
            for part in slices(batch):
                made = each({n: part.column(n).to_pylist() for n in part.schema.names})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def filter_arrow(df: DataFrame, column: str, make: Callable[[], Callable[[list], Iterable[bool]]]) -> DataFrame:
    """The rows, with all their columns, whose value of ``column`` the function made once a task by ``make()`` accepts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accept = None
        for batch in batches:
            accept = accept or make()
            at = batch.schema.get_field_index(column)
            for part in slices(batch):
                yield part.filter(pa.array(accept(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


ARROW = {
    T.LongType: pa.int64(),
    T.IntegerType: pa.int32(),
    T.DoubleType: pa.float64(),
    T.StringType: pa.string(),
    T.BinaryType: pa.binary(),
    T.BooleanType: pa.bool_(),
}


def crc_mod5(column: str):
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5

"""Arriving candidates against stored rows: an extension, for sources that can be read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.identifiers import normalize_identifier
from ..operators.component_store import ComponentStore
from ..plans.reports import ITEM_PROBE, text_matches


def identifier_stream(candidates: DataFrame, rows: DataFrame, field: str) -> DataFrame:
    """Matches of streamed candidates ``(cand, value)``: a stream-static join on the normalised identifier, without state."""
    given = candidates.withColumn("_k", normalize_identifier(F.col("value"))).where("_k <> ''")
    there = rows.select("location", "id", normalize_identifier(F.col(field)).alias("_k"))
    return given.join(there, "_k").drop("_k")


def first_seen(candidates: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Streamed candidates without repeats of an identifier within the watermark, for which alone state is kept."""
    keyed = candidates.withColumn("_k", normalize_identifier(F.col("value"))).withWatermark(ts, late)
    return keyed.dropDuplicatesWithinWatermark(["_k"]).drop("_k")


def description_stream(candidates: DataFrame, rows: DataFrame, path: str, checkpoint: str, threshold: float = ITEM_PROBE) -> StreamingQuery:
    """Writes the matches of streamed items ``(cand, text, numeric)`` to ``path``, a micro-batch at a time.

    A batch that is run again overwrites its own folder, so each match is there once.
    """

    def one(batch: DataFrame, number: int) -> None:
        text_matches(batch, rows, threshold).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return candidates.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def component_stream(links: DataFrame, store: ComponentStore, checkpoint: str, a: str = "a", b: str = "b") -> StreamingQuery:
    """Adds streamed links to stored components, a version for each micro-batch; one that is run again adds nothing."""

    def one(batch: DataFrame, _: int) -> None:
        store.add(batch, a, b)

    return links.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Shapes of rows: records, cache rows, payloads and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_str, normalize_description, numeric_part, text_part
from ..sources.tables import ITEM_COLUMNS, ITEM_EXTRAS


def schema_records(items: DataFrame) -> DataFrame:
    """Item rows as records: the supplier is there when a code or a unit is."""
    out = items.select(
        "row_no",
        F.col("ITEMDESC").alias("_item_description"), F.col("ITEM_TYPE").alias("_item_type"),
        F.col("MAINGROUP").alias("_main_group"), F.col("SUBGROUP").alias("_sub_group"),
        *[c for c in (*ITEM_EXTRAS, "DocNo") if c in items.columns],
    )
    if {"ITEM_CODE", "UOM", "Supplier"} <= set(out.columns):
        known = F.col("ITEM_CODE").isNotNull() | F.col("UOM").isNotNull()
        out = out.withColumn("Supplier", F.when(known, F.coalesce("Supplier", F.lit(""))))
        out = out.withColumn("UOM", F.when(F.col("ITEM_CODE").isNotNull(), F.coalesce("UOM", F.lit(""))).otherwise(F.col("UOM")))
    return out


def minimized(records: DataFrame, compose: bool = True, passes: int = 1) -> DataFrame:
    """Records with the text and the numeric part of their description, null where there is none; a row that has no code
    keeps only its unit of the optional columns."""
    normal = normalize_description(F.col("_item_description"), compose, passes)
    out = records.withColumn("_normal", normal)
    out = out.withColumn("text", F.nullif(text_part(F.col("_normal")), F.lit(""))).withColumn("numeric", F.nullif(numeric_part(F.col("_normal")), F.lit("")))
    if "Supplier" in out.columns:
        out = out.withColumn("Supplier", F.when(F.col("ITEM_CODE").isNotNull(), F.col("Supplier")))
    return out.drop("_normal")


def cache_rows(records: DataFrame) -> DataFrame:
    """What is kept of an item: parts, the four display columns and what there is of the optional ones."""
    names = {"ITEM_TYPE": "_item_type", "MAINGROUP": "_main_group", "SUBGROUP": "_sub_group", "ITEMDESC": "_item_description"}
    extra = [c for c in (*ITEM_EXTRAS, "DocNo") if c in records.columns]
    return records.select("row_no", "text", "numeric", *[F.col(v).alias(k) for k, v in names.items()], *extra)


def embedding_text(text: Column) -> Column:
    """What is embedded of a row: its text part; numbers never are."""
    return F.trim(F.coalesce(text, F.lit("")))


def answer(candidates: DataFrame, matches: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """``(cand, status, matches)``: each candidate with its matches, in the given order, ``duplicate`` if there are any."""
    match = F.struct(*order, *[f for f in fields if f not in order])
    found = matches.groupBy("cand").agg(F.sort_array(F.collect_list(match)).alias("_m"))
    rows = candidates.select("cand").join(found, "cand", "left")
    listed = F.transform(F.coalesce("_m", F.array().cast(found.schema["_m"].dataType)), lambda m: F.struct(*[m[f].alias(f) for f in fields]))
    return rows.select("cand", F.when(F.size(listed) > 0, "duplicate").otherwise("unique").alias("status"), listed.alias("matches"))


def location_counts(matches: DataFrame) -> DataFrame:
    """How many matches there are in each location."""
    return matches.groupBy("location").agg(F.count("*").alias("n"))


def location_rank(location: Column) -> Column:
    """The main table comes before the approval queue."""
    return F.when(location == "db", 0).otherwise(1)


def clean_columns(rows: DataFrame) -> DataFrame:
    """The display columns with nulls, ``nan`` and ``none`` as empty."""
    return rows.withColumns({c: clean_str(F.col(c)) for c in ITEM_COLUMNS if c in rows.columns})

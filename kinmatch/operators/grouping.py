"""Duplicate groups: members, numbers, and what is reported of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import normalize_identifier
from ..functions.text import match_key


def groups_by_key(rows: DataFrame, key: Column) -> DataFrame:
    """``(row_no, group_min)`` of rows that share a key, which isn't empty, with another."""
    keyed = rows.select("row_no", key.alias("_k")).where("_k <> ''")
    sizes = keyed.groupBy("_k").agg(F.min("row_no").alias("group_min"), F.count("*").alias("size")).where("size > 1")
    return keyed.join(sizes, "_k").select("row_no", "group_min")


def identifier_groups(vendors: DataFrame, field: str) -> DataFrame:
    return groups_by_key(vendors, normalize_identifier(F.col(f"`{field}`")))


def groups_of_texts(rows: DataFrame, text: str, key: str, components: DataFrame, reps: DataFrame) -> DataFrame:
    """``(row_no, group_min)``: rows by the component of their distinct text, of at least two rows.

    ``reps (t, k, rep, n)`` are the distinct texts and ``components (node, component_id)`` those linked to another.
    """
    named = reps.join(components, F.col("rep") == F.col("node"), "left").select("t", "k", "n", F.coalesce("component_id", "rep").alias("group_min"))
    sizes = named.groupBy("group_min").agg(F.sum("n").alias("size")).where("size > 1").select("group_min")
    of_text = named.join(sizes, "group_min").select("t", "k", "group_min")
    return rows.join(of_text, (F.col(text) == F.col("t")) & (F.col(key) == F.col("k"))).select("row_no", "group_min")


def numbered(groups: DataFrame) -> DataFrame:
    """Adds ``group_id`` DUP_1, DUP_2, ... by the groups' smallest members (one row a group is put in order)."""
    firsts = groups.select("group_min").distinct()
    from ..sources.tables import with_row_no

    order = with_row_no(firsts, [F.col("group_min").asc()], "_no").select("group_min", F.concat(F.lit("DUP_"), F.col("_no")).alias("group_id"))
    return groups.join(order, "group_min")


def totals(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: total_records, valid_records, duplicate_records and Data_quality_score (0 for an empty table)."""
    extra = groups.groupBy("group_min").agg((F.count("*") - 1).alias("extra")).agg(F.lit(0).alias("n"), F.coalesce(F.sum("extra"), F.lit(0)).alias("extra"))
    both = rows.agg(F.count("*").alias("n"), F.lit(0).alias("extra")).unionByName(extra)
    both = both.agg(F.sum("n").alias("total_records"), F.sum("extra").alias("duplicate_records"))
    valid = F.col("total_records") - F.col("duplicate_records")
    score = F.when(F.col("total_records") == 0, F.lit(0.0)).otherwise(F.round(valid * 100.0 / F.col("total_records"), 2))
    return both.select("total_records", valid.alias("valid_records"), "duplicate_records", score.alias("Data_quality_score"))


def column_status(rows: DataFrame, groups: DataFrame, columns: Sequence[str], always_different: Sequence[str] = ("ITEMDESC",)) -> DataFrame:
    """For each group, whether a column has one value in all its rows (``exact``, by stripped lower case) or not."""
    def status(c: str) -> Column:
        if c in always_different:
            return F.lit("different").alias(c)
        key = match_key(F.col(f"`{c}`"))
        return F.when(F.min(key) == F.max(key), "exact").otherwise("different").alias(c)

    return rows.join(groups, "row_no").groupBy("group_min").agg(*[status(c) for c in columns])


def field_report(vendors: DataFrame, fields: Sequence[str], id_: str = "id") -> DataFrame:
    """``(field, group_min, id, value)``: the members of all fields' identifier groups, from one pass over the rows."""
    stack = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields]))
    long = vendors.select("row_no", F.col(id_).alias("id"), stack.alias("_f")).select("row_no", "id", "_f.field", "_f.value")
    keyed = long.withColumn("_k", normalize_identifier(F.col("value"))).where("_k <> ''")
    sizes = keyed.groupBy("field", "_k").agg(F.min("row_no").alias("group_min"), F.count("*").alias("size")).where("size > 1")
    return keyed.join(sizes, ["field", "_k"]).select("field", "group_min", "id", F.coalesce("value", F.lit("")).alias("value"))


def field_totals(report: DataFrame) -> DataFrame:
    """``(field, duplicate_groups, duplicate_records)`` of a field report."""
    sizes = report.groupBy("field", "group_min").agg(F.count("*").alias("size"))
    return sizes.groupBy("field").agg(F.count("*").alias("duplicate_groups"), F.sum(F.col("size") - 1).alias("duplicate_records"))


def nested(rows: DataFrame, groups: DataFrame, status: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(group_id, status, records)``: the nested form of a report, one row a group, records by row number."""
    record = F.struct(F.col("row_no"), *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])
    members = rows.join(numbered(groups), "row_no").groupBy("group_min", "group_id").agg(F.sort_array(F.collect_list(record)).alias("records"))
    return members.join(status.select("group_min", F.struct(*columns).alias("status")), "group_min").select("group_id", "status", "records")


def smallest_first(groups: DataFrame) -> DataFrame:
    """``(representative, duplicates)``: each group's smallest row and the others, in order."""
    members = groups.groupBy("group_min").agg(F.sort_array(F.collect_list("row_no")).alias("m"))
    return members.select(F.col("group_min").alias("representative"), F.slice("m", 2, F.size("m")).alias("duplicates"))


def first_of_each(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows without the extra members of groups."""
    extra = groups.where("row_no <> group_min").select("row_no")
    return rows.join(extra, "row_no", "left_anti")



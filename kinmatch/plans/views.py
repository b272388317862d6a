"""The engine's relations over the tables at hand: items are parts, vendors are customers, catalogs their codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_description, numeric_part, text_part

ITEM_STATUS = ("ITEM_TYPE", "MAINGROUP", "SUBGROUP", "ITEMDESC")
FIELDS = ("CNIC", "NTN", "STRN", "AccountNo", "IBAN")

#: Vendors' identifiers, from the key by modulo, with varying punctuation, letter case and leading zeros; in both dialects of SQL.
VENDOR = {
    "row_no": "c_custkey",
    "id": "c_custkey",
    "Name": "'Vendor ' || CAST(c_custkey % 613 AS STRING) || ' ' || lower(c_mktsegment)",
    "CNIC": "CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_custkey % 997 AS STRING), 5, '1') || '-' || lpad(CAST(c_custkey % 997 AS STRING), 7, '2') || '-1' "
    "ELSE lpad(CAST(c_custkey % 997 AS STRING), 5, '1') || lpad(CAST(c_custkey % 997 AS STRING), 7, '2') || '1' END",
    "NTN": "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN '00' || CAST(c_custkey % 1213 AS STRING) ELSE CAST(c_custkey % 1213 AS STRING) END",
    "STRN": "CASE WHEN c_custkey % 2 = 0 THEN 'St-' ELSE 'ST ' END || CAST(c_custkey % 1511 AS STRING)",
    "AccountNo": "CASE WHEN c_custkey % 5 = 0 THEN ' - ' WHEN c_custkey % 11 = 0 THEN '000' ELSE 'ac/' || CAST(c_custkey % 1201 AS STRING) END",
    "IBAN": "'PK36 SCBL ' || lpad(CAST(c_custkey AS STRING), 10, '0')",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their text and numeric part; the texts are ASCII, so they need no composition."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_no"),
        F.col("p_type").alias("ITEM_TYPE"),
        F.col("p_brand").alias("MAINGROUP"),
        F.regexp_extract("p_name", "([^ ]+)$", 1).alias("SUBGROUP"),
        F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("mm")).alias("ITEMDESC"),
    )
    return with_parts(part)


def with_parts(rows: DataFrame) -> DataFrame:
    normal = normalize_description(F.col("ITEMDESC"), compose=False)
    return rows.withColumn("normal", normal).withColumn("text", text_part(F.col("normal"))).withColumn("numeric", F.lower(numeric_part(F.col("normal")))).drop("normal")


def approval(rows: DataFrame) -> DataFrame:
    """The queue of rows that wait for approval: every tenth."""
    return rows.where("row_no % 10 = 0")


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(*[F.expr(v).alias(k) for k, v in VENDOR.items()])


def located(main: DataFrame, queue: DataFrame) -> DataFrame:
    """Both relations, each row with its location."""
    return main.withColumn("location", F.lit("db")).unionByName(queue.withColumn("location", F.lit("approval")))

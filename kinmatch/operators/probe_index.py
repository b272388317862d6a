"""Rows published for probes, so that a probe reads what its candidates may match and not the table.

Two Parquet tables lie below one path: postings, which are the rarest tokens of each distinct text with the text itself,
and members, the rows that have a text. Both are in folders by a hash, of the key and token or of the text, and sorted
within; a probe names its folders in a filter on the partition column, which needs no scan to be decided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored
from .similarity import _prefix, text_id, token_weights

#: Rows of a folder, on average; folders of a table at most.
FOLDER_ROWS, FOLDERS = 1 << 16, 4096
#: Keys that a probe names in a filter on the postings; of more of them Parquet would only keep the least and the greatest.
KEYS = 10


def _folder(folders: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(folders)).cast("int")


def _texts(rows: DataFrame) -> DataFrame:
    """``(rep, k, t)``: each distinct text with its key; a null of either is left out."""
    known = rows.where("text IS NOT NULL AND numeric IS NOT NULL")
    return known.select(text_id("text", "numeric").alias("rep"), F.col("numeric").alias("k"), F.col("text").alias("t")).distinct()


def _blank(texts: DataFrame) -> DataFrame:
    """``(k, token, rep)`` of texts without a word: they stand under an empty token."""
    return texts.where("t = ''").select("k", F.lit("").alias("token"), "rep")


def publish(rows: DataFrame, path: str, threshold: float, folder_rows: int = FOLDER_ROWS) -> ProbeIndex:
    """Writes the index of ``rows (location, row_no, text, numeric)`` for probes at ``threshold`` or above.

    The last thing written is what a reader opens first. A frequent key or token is cut into ranges with the rest.
    """
    spark = rows.sparkSession
    given = stored(rows.select("location", "row_no", "text", "numeric"))
    texts = stored(_texts(given))
    weights = stored(token_weights(texts))
    prefix = _prefix(weights, weights.groupBy("k", "token").agg(F.count("*").alias("df")), threshold)
    postings = prefix.unionByName(_blank(texts)).join(texts.select("rep", "t"), "rep")
    folders = max(1, min(FOLDERS, -(-given.count() // folder_rows)))
    members = given.where("text IS NOT NULL AND numeric IS NOT NULL").select(text_id("text", "numeric").alias("rep"), "location", "row_no")
    for name, table, of, order in (
        ("postings", postings, ("k", "token"), ("k", "token", "rep")),
        ("members", members, ("rep",), ("rep", "location", "row_no")),
    ):
        placed = table.withColumn("folder", _folder(folders, *of)).repartitionByRange("folder", *order)
        placed.sortWithinPartitions("folder", *order).write.partitionBy("folder").parquet(f"{path}/{name}")
    about = {"threshold": float(threshold), "folders": folders, "row_type": given.schema["row_no"].dataType.simpleString()}
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in about.items()]).coalesce(1).write.parquet(f"{path}/about")
    return ProbeIndex(spark, path)


class ProbeIndex:
    """An index that ``publish`` has written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = spark.read.parquet(f"{path}/about").first()
        self.threshold, self.folders, self.row_type = about["threshold"], about["folders"], about["row_type"]

    def _read(self, name: str, schema: str, folders: DataFrame) -> DataFrame:
        """Of a table only the folders named in ``folders (folder)``, of which there are ``FOLDERS`` at most."""
        wanted = [r[0] for r in folders.distinct().collect()]
        return self.spark.read.schema(f"{schema}, folder int").parquet(f"{self.path}/{name}").where(F.col("folder").isin(wanted))

    def matches(self, candidates: DataFrame, threshold: float | None = None) -> DataFrame:
        """``(cand, location, row_no)``: what ``text_matches`` finds for ``candidates (cand, text, numeric)`` among the rows.

        ValueError for a threshold below the index's, whose postings would miss pairs.
        """
        threshold = self.threshold if threshold is None else threshold
        if threshold < self.threshold:
            raise ValueError(f"the index is for a threshold of {self.threshold} or above")
        texts = stored(_texts(candidates))
        own = stored(token_weights(texts).withColumnRenamed("rep", "a"))
        asked = own.select("k", "token", "a").unionByName(_blank(texts).withColumnRenamed("rep", "a"))
        asked = stored(asked.withColumn("folder", _folder(self.folders, "k", "token")))
        postings = self._read("postings", "k string, token string, rep string, t string", asked.select("folder"))
        keys = [r[0] for r in texts.select("k").distinct().limit(KEYS + 1).collect()]
        if len(keys) <= KEYS:  # row groups without any of the keys are skipped
            postings = postings.where(F.col("k").isin(keys))
        met = stored(postings.join(asked.drop("folder"), ["k", "token"]))
        there = token_weights(met.where("token <> ''").select("rep", "k", "t").distinct()).select("rep", "token", F.col("w").alias("wb"))
        pairs = met.where("token <> ''").select("a", "rep").distinct()
        scored = pairs.join(own.select("a", "token", "w"), "a").join(there, ["rep", "token"]).groupBy("a", "rep").agg(F.sum(F.col("w") * F.col("wb")).alias("cosine"))
        similar = scored.where(F.col("cosine") >= threshold - 1e-12).select("a", "rep")
        hits = stored(similar.unionByName(met.where("token = ''").select("a", "rep")))
        members = self._read("members", f"rep string, location string, row_no {self.row_type}", hits.select(_folder(self.folders, "rep").alias("folder")))
        known = candidates.where("text IS NOT NULL AND numeric IS NOT NULL").select("cand", text_id("text", "numeric").alias("a"))
        return members.join(hits, "rep").join(known, "a").select("cand", "location", "row_no")

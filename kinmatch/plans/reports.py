"""Clusters and probes over items, vendors and catalogs, from operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import normalize_identifier
from ..functions.uom import canonical_uom
from ..operators.components import connected_components
from ..operators.grouping import first_of_each, groups_of_texts
from ..operators.similarity import distinct_texts, text_id, token_links, token_pairs, token_weights, vector_links
from ..sources.shared import stored

ITEM_CLUSTER, ITEM_PROBE = 0.985, 0.75
VENDOR_CLUSTER, NAME_PROBE = 0.9, 0.97


def text_groups(rows: DataFrame, text: str, key: str, threshold: float) -> DataFrame:
    """``(row_no, group_min)``: rows whose texts are similar, transitively, and whose keys are equal.

    The rows are written first: they are read twice, and their texts are costly to normalise.
    """
    rows = stored(rows.select("row_no", F.col(text).alias("text"), F.col(key).alias("numeric")))
    reps = stored(distinct_texts(rows, "text", "numeric"))
    links = token_links(stored(token_weights(reps)), threshold)
    return groups_of_texts(rows, "text", "numeric", connected_components(links, "a", "b"), reps)


def item_groups(items: DataFrame, threshold: float = ITEM_CLUSTER) -> DataFrame:
    return text_groups(items, "text", "numeric", threshold)


def vector_groups(rows: DataFrame, threshold: float) -> DataFrame:
    """``(vec_id, component_id)`` of vectors that are linked to another."""
    return connected_components(vector_links(rows, "vec_id", "embedding", threshold), "a", "b").withColumnRenamed("node", "vec_id")


def text_matches(candidates: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """``(cand, location, row_no)``: rows similar to candidates ``(cand, text, numeric)`` with an equal numeric part.

    Two texts without a word are as similar as equal ones: what has no token but an equal key is a match. A null text or
    key matches nothing. Only rows with a candidate's key are read into tokens. Rows of two locations may have the same
    number: a text is known by a digest, not by a row that has it. ``ProbeIndex`` answers the same from published tables.
    """
    known = lambda df, *names: df.where("text IS NOT NULL AND numeric IS NOT NULL").select(*names, text_id("text", "numeric").alias("rep"), F.col("text").alias("t"), F.col("numeric").alias("k"))
    candidates = stored(known(candidates, "cand"))
    rows = stored(known(rows, "location", "row_no").join(candidates.select("k").distinct(), "k", "left_semi"))
    given, there = (df.select("rep", "k", "t").distinct() for df in (candidates, rows))
    similar = token_pairs(token_weights(given), token_weights(there), threshold, own=False).select("a", "b")
    blank = given.where("t = ''").select("k", F.col("rep").alias("a")).join(there.where("t = ''").select("k", F.col("rep").alias("b")), "k").select("a", "b")
    hits = similar.unionByName(blank)
    c, r = candidates.select("cand", F.col("rep").alias("a")), rows.select("location", "row_no", F.col("rep").alias("b"))
    return hits.join(c, "a").join(r, "b").select("cand", "location", "row_no")


def bulk(batch: DataFrame, rows: DataFrame, cluster: float = ITEM_CLUSTER, probe: float = ITEM_PROBE) -> tuple[DataFrame, DataFrame]:
    """Groups within a submitted batch, ``(row_no, group_min)``, and the verdict ``(pos, status, n_matches)`` on the rest.

    Extra members of a group aren't probed.
    """
    groups = stored(text_groups(batch, "text", "numeric", cluster))
    survivors = stored(first_of_each(batch, groups).select(F.col("row_no").alias("cand"), "text", "numeric"))
    found = text_matches(survivors, rows, probe).groupBy("cand").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    verdict = survivors.join(found, "cand", "left").select(F.col("cand").alias("pos"), F.when(n > 0, "duplicate").otherwise("unique").alias("status"), n.alias("n_matches"))
    return groups, verdict


def identifier_matches(candidates: DataFrame, rows: DataFrame, field: str) -> DataFrame:
    """``(cand, location, id, field_value)``: rows with the candidate's identifier; an empty one matches nothing."""
    given = candidates.select("cand", normalize_identifier(F.col("value")).alias("_k")).where("_k <> ''")
    there = rows.select("location", "id", F.col(field).alias("field_value"), normalize_identifier(F.col(field)).alias("_k"))
    return there.join(given, "_k").select("cand", "location", "id", "field_value")


def name_matches(candidates: DataFrame, rows: DataFrame, threshold: float = NAME_PROBE) -> DataFrame:
    """Matches of names, which have no numeric part: the whole text is compared."""
    whole = lambda df: df.withColumn("numeric", F.lit(""))
    return text_matches(whole(candidates), whole(rows), threshold)


def uom_matches(candidates: DataFrame, catalog: DataFrame, threshold: float = NAME_PROBE) -> DataFrame:
    """``(cand, id, how)``: units with the candidate's canonical code or, only if there are none, a similar label.

    Each distinct value is looked up once. A blank candidate, or one of which no letter or digit is left, matches nothing.
    """
    asked = stored(candidates.select("value").distinct().withColumn("_c", canonical_uom(F.col("value"))).where("_c <> ''"))
    there = catalog.withColumn("_c", canonical_uom(F.col("text"))).where("text <> '' and _c <> ''")
    same = stored(there.join(asked, "_c").select("value", "id", F.lit("alias").alias("how")))
    rest = asked.join(same.select("value").distinct(), "value", "left_anti").select(F.col("value").alias("cand"), F.col("value").alias("text"))
    near = name_matches(rest, catalog.select(F.col("id").alias("row_no"), "text", F.lit("db").alias("location")), threshold)
    found = same.unionByName(near.select(F.col("cand").alias("value"), F.col("row_no").alias("id"), F.lit("similar").alias("how")))
    return candidates.join(found, "value").select("cand", "id", "how")

"""Connected components of a graph of links, by alternating large-star and small-star steps (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.sources.shared import durable


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))"), F.sum(F.expr("hi % 1048573"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the least of all its neighbours and itself; a row for each link."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lo"), F.least("u", "m").alias("m"))
    return edges.join(least, "lo").select("hi", F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component_id)`` for each end of a link in ``edges``; component_id is the smallest node that can be reached.

    Links are undirected; repeated links, loops and links with a null end are allowed, the last two add nothing.
    Each step only takes minima per node (combined before the shuffle) and joins; no node's links meet in one
    task's memory, and nothing but three numbers a step reaches the driver. The number of steps is logarithmic.
    """
    known = durable(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), F.col(a).alias("x"), F.col(b).alias("y"))
        .where("x <> y")
        .select("hi", "lo")
        .distinct()
    )
    before = _signature(known)
    while before[0]:
        known = durable(_small_star(durable(_large_star(known))))
        after = _signature(known)
        if after == before:
            break
        before = after
    tops = known.select(F.col("lo").alias("node"), F.col("lo").alias("component_id")).distinct()
    return known.select(F.col("hi").alias("node"), F.col("lo").alias("component_id")).unionByName(tops)

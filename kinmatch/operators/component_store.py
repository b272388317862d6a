"""Connected components kept up to date: batches of links are added to stored components, of which only those touched change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored
from ..sources.version_log import Entry, VersionLog
from .components import connected_components

#: What a version's folders hold: ``nodes`` (node, label) as first seen; ``labels`` and ``members`` both (label,
#: component_id) of labels that were merged into a smaller one, dealt by label and by component_id.
KINDS = {"nodes": ("node", "node long, label long"), "labels": ("label", "label long, component_id long"), "members": ("component_id", "label long, component_id long")}


class ComponentStore:
    """``(node, component_id)`` of all links added so far; component_id is the smallest node that can be reached.

    A node keeps the label it was first stored with, the smallest node of its component then. If components are merged,
    only the labels of the merged ones get a new component, which is always a smaller one, so that the least counts.
    All three tables are dealt to ``parts`` folders by a hash; a batch reads the folders of its own nodes and of the
    components that they touch. After ``batches`` batches, the next one writes all nodes anew with their components.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 64, batches: int = 32):
        self.spark, self.log, self.parts, self.batches = spark, VersionLog(spark, path), parts, batches

    def _part(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def _table(self, kind: str, entry: Entry, keys: DataFrame | None = None) -> DataFrame:
        """A table of a version; with ``keys``, a column of the table's key, only the folders that may hold them."""
        key, schema = KINDS[kind]
        folders = [f"{self.log.path}/{f}/kind={kind}" for f in entry.folders]
        rows = self.spark.read.schema(f"{schema}, v string, kind string, part int").option("basePath", self.log.path).parquet(*folders)
        if keys is not None:
            asked = [r[0] for r in keys.select(self._part(key).alias("part")).distinct().collect()]  # at most ``parts``
            rows = rows.where(F.col("part").isin(asked)).join(keys, key, "left_semi")
        return rows.drop("v", "kind", "part")

    def _write(self, rows: DataFrame, kind: str, folder: str) -> None:
        placed = rows.withColumn("part", self._part(KINDS[kind][0]))
        placed.repartition("part").sortWithinPartitions("part", KINDS[kind][0]).write.partitionBy("part").parquet(f"{self.log.path}/{folder}/kind={kind}")

    def _found(self, nodes: DataFrame, entry: Entry | None) -> DataFrame:
        """``(node, now)``: of the given nodes, now null for those that aren't stored."""
        if entry is None:
            return nodes.withColumn("now", F.lit(None).cast("long"))
        labelled = stored(self._table("nodes", entry, nodes))
        merged = self._table("labels", entry, labelled.select("label").distinct()).groupBy("label").agg(F.min("component_id").alias("component_id"))
        now = labelled.join(merged, "label", "left").select("node", F.coalesce("component_id", "label").alias("now"))
        return nodes.join(now, "node", "left")

    def read(self, number: int | None = None) -> DataFrame:
        """``(node, component_id)`` of the current version, or of an earlier one; without rows before the first."""
        entry = self.log.latest() if number is None else self.log.entry(number)
        if entry is None:
            return self.spark.createDataFrame([], "node long, component_id long")
        return self._whole(entry)

    def _whole(self, entry: Entry) -> DataFrame:
        merged = self._table("labels", entry).groupBy("label").agg(F.min("component_id").alias("component_id"))
        return self._table("nodes", entry).join(merged, "label", "left").select("node", F.coalesce("component_id", "label").alias("component_id"))

    def add(self, links: DataFrame, a: str, b: str) -> Entry | None:
        """Adds links between whole numbers and publishes a version with them; the current one if they change nothing.

        Links are undirected; loops and links with a null end add nothing, nor do links added before, so a batch may be
        run again. If another writer has published in the meantime, ``Conflict``: run the batch again. If anything
        fails, the stored components stay as they are.
        """
        entry = self.log.latest()
        ends = stored(links.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x <> y").distinct())
        nodes = stored(ends.select(F.explode(F.array("x", "y")).alias("node")).distinct())
        nodes = stored(self._found(nodes, entry))
        end = lambda name, to: nodes.select(F.col("node").alias(name), F.coalesce("now", "node").alias(to))
        touched = ends.join(end("x", "p"), "x").join(end("y", "q"), "y").where("p <> q").select("p", "q").distinct()
        merged = stored(connected_components(touched, "p", "q"))
        if merged.isEmpty():
            return entry
        old = nodes.where("now IS NOT NULL").select(F.col("now").alias("node")).distinct()
        moved = stored(merged.where("node <> component_id").join(old, "node", "left_semi").select(F.col("node").alias("was"), "component_id"))
        fresh = nodes.where("now IS NULL").join(merged, "node").select("node", F.col("component_id").alias("label"))
        relabelled = moved.select(F.col("was").alias("label"), "component_id")
        if entry is not None:
            # a label that points to a component of now hasn't been merged any further
            pointing = self._table("members", entry, moved.select(F.col("was").alias("component_id"))).withColumnRenamed("component_id", "was")
            relabelled = relabelled.unionByName(pointing.join(moved, "was").select("label", "component_id").distinct())
        return self._publish(entry, fresh, stored(relabelled))

    def _publish(self, entry: Entry | None, fresh: DataFrame, relabelled: DataFrame) -> Entry:
        folder = self.log.new_folder()
        folders = [*(entry.folders if entry else ()), folder]
        try:
            for kind, rows in (("nodes", fresh), ("labels", relabelled), ("members", relabelled)):
                self._write(rows, kind, folder)
            if len(folders) > self.batches:
                staged, folder = folder, self.log.new_folder()
                whole = self._whole(Entry(0, tuple(folders)))
                self._write(whole.withColumnRenamed("component_id", "label"), "nodes", folder)
                for kind in ("labels", "members"):
                    self._write(relabelled.limit(0), kind, folder)
                self.log.delete(staged)
                folders = [folder]
            return self.log.commit(entry, folders)
        except Exception:
            self.log.delete(folder)
            raise

"""The engine's fifteen operations, as methods that take and return DataFrames.

Items and vendors keep their vectors in a store, which ``*_update_embeddings`` writes and the others only read.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions.identifiers import normalize_identifier
from .functions.spell import correct_spelling
from .functions.text import match_key, normalize_description
from .functions.uom import canonical_uom
from .functions.vectors import Embedder, HashedTokens, embed
from .operators.components import connected_components
from .operators.grouping import column_status, field_report, field_totals, first_of_each, groups_of_texts, numbered, smallest_first, totals
from .operators.similarity import distinct_texts, vector_links, vector_probe
from .plans.records import answer, cache_rows, embedding_text, location_rank, minimized, schema_records
from .sources.shared import stored
from .sources.store import Store, Summary, guard
from .sources.tables import ITEM_COLUMNS, catalog_rows, item_rows, vendor_rows

#: Vendors' identifier fields, by the name that a report gives them.
IDENTIFIERS = {"CNIC": "CNIC", "NTN": "NTN", "STRN": "SalesTaxNo", "Account No": "AccountNo", "IBAN": "IbanNO"}


@dataclass
class Engine:
    """``path`` is where stores are; ``terms`` is the spelling dictionary, (term, frequency), none to leave spelling alone."""

    spark: SparkSession
    path: str
    embedder: Embedder = field(default_factory=HashedTokens)
    settings: Settings = field(default_factory=Settings)
    terms: Iterable[tuple[str, int]] = ()

    def __post_init__(self) -> None:
        self.items = Store(self.spark, f"{self.path.rstrip('/')}/items")
        self.vendors = Store(self.spark, f"{self.path.rstrip('/')}/vendors")

    # -- items

    def _prepared(self, items: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        """Items with their parts and vectors; with ``keys (k)``, only those of one of the keys."""
        rows = cache_rows(minimized(schema_records(items), passes=self.settings.passes))
        rows = rows if keys is None else rows.join(keys, match_key(F.col("numeric")) == F.col("k"), "left_semi")
        return embed(rows.withColumn("_t", embedding_text(F.col("text"))), "_t", self.embedder).drop("_t")

    def item_update_embeddings(self, view: DataFrame) -> Summary:
        """Scans, prepares, embeds and publishes all items."""
        return self.items.write(self._prepared(item_rows(view, extras="ITEM_CODE" in view.columns)), self.embedder.name)

    def _groups(self, rows: DataFrame, threshold: float) -> DataFrame:
        """``(row_no, group_min)`` of ``(row_no, text, numeric)`` rows; each distinct text is compared once.

        Its vector is that of its first row where rows have an ``embedding``, else it is made here, once a text.
        """
        keyed = rows.select("row_no", embedding_text(F.col("text")).alias("text"), match_key(F.col("numeric")).alias("numeric"))
        reps = stored(distinct_texts(keyed, "text", "numeric"))
        if "embedding" in rows.columns:
            vectors = rows.select(F.col("row_no").alias("rep"), F.col("embedding").alias("v")).join(reps.select("rep", "k"), "rep")
        else:
            vectors = stored(embed(reps.select("rep", "k", "t"), "t", self.embedder, "v"))
        pairs = vector_links(vectors, "rep", "v", threshold, F.col("k"))
        return groups_of_texts(keyed, "text", "numeric", connected_components(pairs, "a", "b"), reps)

    def item_duplicate_engine(self) -> tuple[DataFrame, DataFrame]:
        """The totals, one row, and the groups ``(group_id, status, records)`` of the published items."""
        rows = self.items.read()
        groups = stored(self._groups(rows, self.settings.item_cluster))
        shown = [c for c in rows.columns if c not in ("row_no", "text", "numeric", "embedding")]
        return totals(rows, groups), self._nested(rows, groups, shown)

    @staticmethod
    def _nested(rows: DataFrame, groups: DataFrame, shown: list[str]) -> DataFrame:
        status = column_status(rows, groups, ITEM_COLUMNS).select("group_min", F.struct(*ITEM_COLUMNS).alias("status"))
        record = F.struct("row_no", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in shown])
        members = rows.join(numbered(groups), "row_no").groupBy("group_min", "group_id").agg(F.sort_array(F.collect_list(record)).alias("records"))
        return members.join(status, "group_min").select("group_id", "status", "records")

    def _places(self, approval: DataFrame | None, keys: DataFrame) -> DataFrame:
        """The published items and the approval queue as it is now, with their vectors and keys, as far as they have one of ``keys (k)``.

        Others of the queue get no vector, and of the published ones no copy is made.
        """
        found = self.items.summary()
        if found is None:
            raise FileNotFoundError("items have no published version")
        guard(found, self.embedder.name, getattr(self.embedder, "width", None))
        take = lambda df, place: df.select(F.lit(place).alias("location"), "row_no", "ITEMDESC", F.col("embedding").alias("v"), match_key(F.col("numeric")).alias("k"))
        out = take(self.items.read(), "db").join(keys, "k", "left_semi")
        return out if approval is None else out.unionByName(take(self._prepared(item_rows(approval), keys), "approval"))

    def _item_matches(self, candidates: DataFrame, approval: DataFrame | None) -> DataFrame:
        """``(cand, location, row#, ITEMDESC)`` of prepared candidates ``(row_no, numeric, embedding)``."""
        keys = candidates.select(match_key(F.col("numeric")).alias("k")).distinct()
        places = stored(self._places(approval, keys).withColumn("id", F.struct("location", "row_no")))
        given = candidates.select(F.col("row_no").alias("cand"), F.col("embedding").alias("v"), match_key(F.col("numeric")).alias("k"))
        hits = vector_probe(given, places.select("id", "v", "k"), self.settings.item_probe, key=True)
        return hits.join(places.select("id", "location", "ITEMDESC", F.col("row_no").alias("row#")), "id").drop("id").withColumn("_rank", location_rank(F.col("location")))

    def _given(self, descriptions: list[str], spell: bool) -> DataFrame:
        rows = self.spark.createDataFrame([(i, d) for i, d in enumerate(descriptions)], "row_no long, ITEMDESC string")
        if spell and self.terms:
            rows = rows.withColumn("ITEMDESC", correct_spelling(F.col("ITEMDESC"), self.terms))
        for c in ITEM_COLUMNS[:3]:
            rows = rows.withColumn(c, F.lit(""))
        return self._prepared(rows)

    def item_check_duplicate_variant(self, description: str, approval: DataFrame | None = None) -> DataFrame:
        """``(cand, status, matches)`` of one description, its spelling corrected."""
        given = stored(self._given([description], spell=True))
        return answer(given.select(F.col("row_no").alias("cand")), self._item_matches(given, approval), ["ITEMDESC", "location", "row#"], ["_rank", "row#"])

    def item_check_duplicate_bulk(self, descriptions: list[str], approval: DataFrame | None = None) -> dict[str, DataFrame]:
        """Groups within the batch, and the answers for the first of each and the others; spelling is left alone."""
        if not descriptions:
            raise ValueError("the batch is empty")
        batch = stored(self._given(descriptions, spell=False))
        groups = stored(self._groups(batch, self.settings.item_cluster))
        rest = stored(first_of_each(batch, groups))
        results = answer(rest.select(F.col("row_no").alias("cand")), self._item_matches(rest, approval), ["ITEMDESC", "location", "row#"], ["_rank", "row#"])
        summary = batch.join(rest.select("row_no", F.lit(1).alias("_rest")), "row_no", "left").agg(F.count("*").alias("total_submitted"), F.count("_rest").alias("unique_count"))
        return {"summary": summary, "groups": smallest_first(groups), "results": results}

    # -- vendors

    def vendor_update_embeddings(self, view: DataFrame) -> Summary:
        rows = vendor_rows(view).withColumn("text", F.coalesce(F.col("Name"), F.lit("")))
        return self.vendors.write(embed(rows, "text", self.embedder), self.embedder.name)

    def vendor_duplicate_engine(self, view: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``(field, duplicate_groups, duplicate_records)`` and ``(field, group_min, id, value)``: the name and five identifiers,
        each by itself. Vectors are computed for this report; nothing is written to the store."""
        rows = stored(vendor_rows(view))
        named = rows.select("row_no", F.col("Name").alias("text"), F.lit("").alias("numeric"))
        names = self._groups(named, self.settings.vendor_cluster).join(rows.select("row_no", F.col("id"), F.coalesce("Name", F.lit("")).alias("value")), "row_no")
        labelled = rows.select("row_no", "id", *[F.col(c).alias(k) for k, c in IDENTIFIERS.items()])
        report = stored(field_report(labelled, list(IDENTIFIERS)).unionByName(names.select(F.lit("NAME").alias("field"), "group_min", "id", "value")))
        return field_totals(report), report

    def vendor_check_duplicate(self, label: str, value: str, view: DataFrame, approval: DataFrame) -> DataFrame:
        """``(cand, status, matches)`` of one identifier: CNIC, NTN, STRN, Account No or IBAN. An empty one matches nothing."""
        return self.vendor_check_identifiers({label: value}, view, approval).drop("label")

    def vendor_check_identifiers(self, values: dict[str, str], view: DataFrame, approval: DataFrame) -> DataFrame:
        """``(label, cand, status, matches)`` of several identifiers by label; rows are numbered and read once for all of them."""
        fields = F.array(*[F.struct(F.lit(k).alias("label"), F.col(IDENTIFIERS[k]).cast("string").alias("field_value")) for k in values])
        given = self.spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(values.items())], "cand long, label string, value string")
        keyed = given.select("cand", "label", normalize_identifier(F.col("value")).alias("_k")).where("_k <> ''")
        places = vendor_rows(view).withColumn("location", F.lit("db")).unionByName(vendor_rows(approval).withColumn("location", F.lit("approval")))
        long = places.select("id", "Name", "location", F.col("row_no").alias("row#"), F.explode(fields).alias("_f")).select("*", "_f.*")
        hits = long.withColumn("_k", normalize_identifier(F.col("field_value"))).join(F.broadcast(keyed), ["label", "_k"])  # a row an identifier
        hits = hits.select("cand", "id", "Name", "field_value", "location", "row#", location_rank(F.col("location")).alias("_rank"))
        answers = answer(given, hits, ["id", "Name", "field_value", "location", "row#"], ["_rank", "row#"])
        return given.select("label", "cand").join(answers, "cand").select("label", "cand", "status", "matches")

    def vendor_check_duplicate_name(self, name: str, approval: DataFrame) -> DataFrame:
        """``(cand, status, matches)`` of a name against the published vendors and the approval queue."""
        guard(self.vendors.summary(), self.embedder.name, getattr(self.embedder, "width", None))
        queue = stored(embed(vendor_rows(approval).withColumn("text", F.coalesce("Name", F.lit(""))), "text", self.embedder))
        both = self.vendors.read().withColumn("location", F.lit("db")).unionByName(queue.withColumn("location", F.lit("approval")), allowMissingColumns=True)
        own = F.struct("location", "row_no").alias("sid")
        reps = stored(both.groupBy("text").agg(F.min(own).alias("sid")))  # equal texts have equal vectors
        vectors = both.select(own, F.col("embedding").alias("v")).join(reps, "sid", "left_semi")
        places = both.select("text", "location", "id", "Name", F.col("row_no").alias("row#")).join(reps, "text").drop("text")
        return self._probe_texts([name], vectors, places, ["id", "Name", "location", "row#"], self.settings.vendor_probe)

    def _probe_texts(self, texts: list[str], vectors: DataFrame, places: DataFrame, fields: list[str], threshold: float) -> DataFrame:
        """``(cand, status, matches)`` of texts: the ``places`` whose ``sid`` is that of one of ``vectors (sid, v)`` that match."""
        given = self.spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "cand long, text string")
        given = stored(embed(given, "text", self.embedder).select("cand", F.col("embedding").alias("v"), F.lit("").alias("k")))
        hits = vector_probe(given, vectors.select(F.col("sid").alias("id"), "v"), threshold, key=False).withColumnRenamed("id", "sid")
        hits = hits.join(places, "sid")
        rank = location_rank(F.col("location")) if "location" in hits.columns else F.lit(0)
        return answer(given, hits.withColumn("_rank", rank), fields, ["_rank", "row#"])

    # -- catalogs

    def _catalog(self, view: DataFrame, column: str, id_: str) -> DataFrame:
        return catalog_rows(view, column, id_)

    def _ready(self, c):
        out = correct_spelling(c, self.terms) if self.terms else c
        return normalize_description(out, passes=self.settings.passes)

    def code_check_duplicate(self, value: str, view: DataFrame, column: str, threshold: float, id_: str = "id") -> DataFrame:
        """``(cand, status, matches)`` of a code in a catalog; both sides are corrected and normalised, whole texts are compared."""
        return self._code_answer(value, self._catalog(view, column, id_), threshold)

    def _code_answer(self, value: str, rows: DataFrame, threshold: float) -> DataFrame:
        if not (value or "").strip():
            rows = rows.limit(0)  # a blank code is unique
        places = embed(rows.withColumn("_t", self._ready(F.col("text"))), "_t", self.embedder)
        places = stored(places.select(F.col("id").alias("sid"), F.col("text").alias("name"), F.col("id").alias("row#"), F.col("embedding").alias("v")))
        ready = self.spark.createDataFrame([(value or "",)], "v string").select(self._ready(F.col("v"))).first()[0]
        return self._probe_texts([ready], places.select("sid", "v"), places.drop("v"), ["name", "row#"], threshold)

    def main_code_check_duplicate_variant(self, value: str, view: DataFrame, column: str = "ItemMainCode_Name") -> DataFrame:
        return self.code_check_duplicate(value, view, column, self.settings.main_code_probe)

    def sub_code_check_duplicate_variant(self, value: str, view: DataFrame, column: str = "ItemSubCode_Name") -> DataFrame:
        return self.code_check_duplicate(value, view, column, self.settings.sub_code_probe)

    def uom_check_duplicate_variant(self, value: str, view: DataFrame, column: str = "UOM_Description") -> DataFrame:
        """Units with the same canonical code or, only if there are none, with a similar label."""
        code = self.spark.createDataFrame([(value or "",)], "v string").select(canonical_uom(self._ready(F.col("v")))).first()[0]
        given = self.spark.createDataFrame([(0,)], "cand long")
        catalog = stored(self._catalog(view, column, "id"))  # else labels are made ready before a distinct beneath the view, row by row
        same = stored(catalog.where("text <> ''").where((canonical_uom(self._ready(F.col("text"))) == code) & F.lit(bool(code))))
        hits = same.select(F.lit(0).cast("long").alias("cand"), F.col("text").alias("name"), F.col("id").alias("row#"), F.lit(0).alias("_rank"))
        if not code or not same.isEmpty():
            return answer(given, hits, ["name", "row#"], ["_rank", "row#"])
        return self._code_answer(value, catalog, self.settings.uom_probe)

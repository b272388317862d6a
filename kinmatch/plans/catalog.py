"""All queries of the engine, by name, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers, schedule, spell, text, uom, vectors
from ..operators import component_store, grouping, probe_index, similarity
from ..sources import ranges, shared, store, tables
from . import records, reports, views

VECTOR_THRESHOLD = 0.35
UNITS = ("kgs", "KG", "Pkt", "packets", "m", "yd", "gm", "foo-bar", "%", " Sq. Feet ", "running metres", "oz/yd")
CATALOG_UNITS = ("Kilogram", "Mtr", "micron", "Odd Unit", "Odd Unit ", "Packet", "")


def vendor_identifier_groups(spark: SparkSession, d: str) -> DataFrame:
    return grouping.identifier_groups(views.vendors(spark, d), "NTN")


def vendor_field_report(spark: SparkSession, d: str) -> DataFrame:
    return grouping.field_report(views.vendors(spark, d), views.FIELDS)


def vendor_field_totals(spark: SparkSession, d: str) -> DataFrame:
    return grouping.field_totals(vendor_field_report(spark, d))


def vendor_name_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = views.vendors(spark, d).select("row_no", F.col("Name").alias("text"), F.lit("").alias("numeric"))
    return reports.text_groups(rows, "text", "numeric", reports.VENDOR_CLUSTER)


def vendor_duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    """The members of the groups of similar names, and of each identifier's groups."""
    rows = views.vendors(spark, d)
    names = vendor_name_groups(spark, d).join(rows.select("row_no", "id", F.coalesce("Name", F.lit("")).alias("value")), "row_no")
    report = grouping.field_report(rows, views.FIELDS)
    return report.unionByName(names.select(F.lit("NAME").alias("field"), "group_min", "id", "value"))


def vendor_duplicate_totals(spark: SparkSession, d: str) -> DataFrame:
    return grouping.field_totals(vendor_duplicate_report(spark, d))


def vendor_identifier_probe(spark: SparkSession, d: str) -> DataFrame:
    v = views.vendors(spark, d)
    candidates = v.where("row_no % 100 = 0").select(F.col("row_no").alias("cand"), F.col("NTN").alias("value"))
    return reports.identifier_matches(candidates, views.located(v, views.approval(v)), "NTN")


def vendor_name_probe(spark: SparkSession, d: str) -> DataFrame:
    v = views.vendors(spark, d).select("row_no", F.col("Name").alias("text"))
    candidates = v.where("row_no % 100 = 0").select(F.col("row_no").alias("cand"), F.upper("text").alias("text"))
    return reports.name_matches(candidates, views.located(v, views.approval(v)))


def clean_str(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events")
    raw = F.expr("CASE event_id % 6 WHEN 0 THEN 'NaN' WHEN 1 THEN 'None' WHEN 2 THEN NULL WHEN 3 THEN ' none ' WHEN 4 THEN '  ' || event_type || ' ' ELSE event_type END")
    return e.select("event_id", text.clean_str(raw).alias("cleaned"))


def normalize_identifier(spark: SparkSession, d: str) -> DataFrame:
    return views.vendors(spark, d).select("row_no", *[identifiers.normalize_identifier(F.col(f)).alias(f) for f in views.FIELDS])


def uom_canonical(spark: SparkSession, d: str) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(u) for u in UNITS]), (F.col("p_partkey") % len(UNITS) + 1).cast("int"))
    return views.table(spark, d, "part").select("p_partkey", uom.canonical_uom(label).alias("canonical"))


def item_text_numeric_split(spark: SparkSession, d: str) -> DataFrame:
    return views.items(spark, d).select("row_no", "text", "numeric")


def item_normalize_full(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions with all kinds of layout, composed and normalised in three passes."""
    raw = F.expr("p_name || ' IM#' || p_partkey || ' PRONG:' || p_size || ' 1,5 x 40''s “A” 10-12 ' || p_size || 'GSM (x)'")
    normal = text.normalize_description(raw, compose=True, passes=3)
    made = views.table(spark, d, "part").select("p_partkey", normal.alias("normal"))
    return made.select("p_partkey", "normal", text.text_part(F.col("normal")).alias("text"), text.numeric_part(F.col("normal")).alias("numeric"))


def item_scan_ordered(spark: SparkSession, d: str) -> DataFrame:
    part = views.table(spark, d, "part")
    order = tables.order_by("p_brand DESC NULLS LAST, p_partkey", part)
    return tables.with_row_no(part.select("p_partkey", "p_brand"), order)


def catalog_scan(spark: SparkSession, d: str) -> DataFrame:
    codes = views.table(spark, d, "part").select("p_brand").distinct()
    return tables.catalog_rows(codes, "p_brand")


def approval_union(spark: SparkSession, d: str) -> DataFrame:
    i = views.items(spark, d).select("row_no", "ITEMDESC")
    return views.located(i, views.approval(i)).groupBy("location").agg(F.count("*").alias("n"), F.countDistinct("ITEMDESC").alias("n_descriptions"))


def rows_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Minimised rows written as JSON lines and read back."""
    rows = views.items(spark, d).select(F.col("row_no").cast("string"), F.nullif("text", F.lit("")).alias("text"), F.nullif("numeric", F.lit("")).alias("numeric"), "ITEM_TYPE")
    path = f"{shared.shared_dir(spark).rstrip('/')}/rows-json-{uuid.uuid4().hex}"
    store.write_json_lines(rows, path)
    return tables.read_json_lines(spark, path, rows.columns)


def vector_pairs_blocked(spark: SparkSession, d: str) -> DataFrame:
    return similarity.vector_pairs(views.table(spark, d, "embeddings"), "vec_id", "embedding", VECTOR_THRESHOLD, F.col("label"))


def vector_pairs_unblocked(spark: SparkSession, d: str) -> DataFrame:
    return similarity.vector_pairs(views.table(spark, d, "embeddings"), "vec_id", "embedding", VECTOR_THRESHOLD)


def vector_exact_groups(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "embeddings")
    copies = e.where("vec_id % 5 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    return similarity.exact_vector_groups(e.unionByName(copies), "vec_id", "embedding")


def vector_components(spark: SparkSession, d: str) -> DataFrame:
    return reports.vector_groups(views.table(spark, d, "embeddings"), VECTOR_THRESHOLD)


def vector_probe(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"), F.col("label").cast("string").alias("k"))
    given = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("cand"), "v", "k")
    return similarity.vector_probe(given, e.select(F.col("vec_id").alias("id"), "v", "k"), VECTOR_THRESHOLD, key=True)


def item_duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    items = views.items(spark, d)
    groups = shared.stored(reports.item_groups(items))
    return items.join(grouping.numbered(groups), "row_no").select("group_id", "row_no", *views.ITEM_STATUS)


def item_duplicate_report_nested(spark: SparkSession, d: str) -> DataFrame:
    items = views.items(spark, d)
    groups = shared.stored(reports.item_groups(items))
    return grouping.nested(items, groups, grouping.column_status(items, groups, views.ITEM_STATUS), views.ITEM_STATUS)


def item_quality_score(spark: SparkSession, d: str) -> DataFrame:
    items = views.items(spark, d)
    return grouping.totals(items, reports.item_groups(items))


def item_column_status(spark: SparkSession, d: str) -> DataFrame:
    items = views.items(spark, d)
    return grouping.column_status(items, shared.stored(reports.item_groups(items)), views.ITEM_STATUS)


def item_variant_probe(spark: SparkSession, d: str) -> DataFrame:
    items = shared.stored(views.items(spark, d).select("row_no", "text", "numeric"))
    given = spark.createDataFrame([(1, "SMALL  ring 11mm"), (2, "red bolt small, 28 MM"), (3, "none")], "cand long, ITEMDESC string")
    return reports.text_matches(views.with_parts(given).select("cand", "text", "numeric"), views.located(items, views.approval(items)), reports.ITEM_PROBE)


def _index_path(spark: SparkSession, what: str) -> str:
    return f"{shared.shared_dir(spark).rstrip('/')}/index-{what}-{uuid.uuid4().hex}"


def item_variant_probe_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of ``item_variant_probe`` against an index of all items that is published first."""
    items = shared.stored(views.items(spark, d).select("row_no", "text", "numeric"))
    index = probe_index.publish(views.located(items, views.approval(items)), _index_path(spark, "items"), reports.ITEM_PROBE)
    given = spark.createDataFrame([(1, "SMALL  ring 11mm"), (2, "red bolt small, 28 MM"), (3, "none")], "cand long, ITEMDESC string")
    return index.matches(views.with_parts(given).select("cand", "text", "numeric"))


def vendor_name_probe_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The names of all vendors, as candidates, against a published index of vendors; how many rows each matches by location."""
    v = views.vendors(spark, d).select("row_no", F.col("Name").alias("text"), F.lit("").alias("numeric"))
    index = probe_index.publish(views.located(v, views.approval(v)), _index_path(spark, "vendors"), reports.NAME_PROBE)
    names = v.groupBy(F.upper("text").alias("text"), "numeric").agg(F.min("row_no").alias("cand"))
    return index.matches(names.select("cand", "text", "numeric")).groupBy("cand", "location").agg(F.count("*").alias("n"))


def item_match_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many matches of the probe there are in each location."""
    return records.location_counts(item_variant_probe(spark, d))


def item_bulk_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of all rows as a batch: how many there are, how many are no repeats within it, and its groups."""
    items = views.items(spark, d)
    groups = shared.stored(reports.item_groups(items))
    rest = grouping.first_of_each(items, groups).agg(F.count("*").alias("unique_count"))
    found = groups.agg(F.countDistinct("group_min").alias("duplicate_groups"))
    return items.agg(F.count("*").alias("total_submitted")).join(rest).join(found)


def item_duplicate_report_records(spark: SparkSession, d: str) -> DataFrame:
    """The records of the nested report, a row each, with the status of their group."""
    nested = item_duplicate_report_nested(spark, d)
    status = [F.col(f"status.{c}").alias(f"{c}_status") for c in views.ITEM_STATUS]
    return nested.select("group_id", *status, F.explode("records").alias("r")).select("group_id", *[f"{c}_status" for c in views.ITEM_STATUS], "r.*")


def _bulk(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All rows as a batch against the whole main table and approval queue."""
    items = shared.stored(views.items(spark, d).select("row_no", "text", "numeric"))
    return reports.bulk(items, views.located(items, views.approval(items)))


def item_bulk_check(spark: SparkSession, d: str) -> DataFrame:
    return _bulk(spark, d)[1]


def item_bulk_groups(spark: SparkSession, d: str) -> DataFrame:
    return grouping.smallest_first(_bulk(spark, d)[0]).select("representative", F.array_join("duplicates", ",").alias("duplicates"))


def catalog_probe(spark: SparkSession, d: str) -> DataFrame:
    """Codes similar to candidates: main codes are brands, sub codes types."""
    part = views.table(spark, d, "part")
    codes = part.select(F.lit("main").alias("location"), F.col("p_brand").alias("text")).unionByName(part.select(F.lit("sub").alias("location"), F.col("p_type").alias("text")))
    codes = codes.groupBy("location", "text").agg(F.count("*").alias("row_no"))
    given = spark.createDataFrame([(1, "brand#7"), (2, "Economy"), (3, "Brand#7 Economy"), (4, "!!!")], "cand long, text string")
    return reports.name_matches(given, codes.select("location", "text", "row_no"))


def uom_cascade(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.createDataFrame(list(enumerate(CATALOG_UNITS, 1)), "id long, text string")
    given = views.table(spark, d, "part").select(F.col("p_partkey").alias("cand"), F.element_at(F.array(*[F.lit(u) for u in (*UNITS, "unit ODD")]), (F.col("p_partkey") % (len(UNITS) + 1) + 1).cast("int")).alias("value"))
    return reports.uom_matches(given, tables.catalog_rows(labels, "text"))


def next_refresh_slot(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "events").select("event_id", schedule.next_slot(F.col("ts"), 4).alias("slot"))


def spell_correct(spark: SparkSession, d: str) -> DataFrame:
    typed = F.regexp_replace(F.regexp_replace("p_name", "ll", "l"), "dge", "deg")
    part = views.table(spark, d, "part")
    rows = part.select("p_partkey", F.concat(typed, F.lit(" 20mm STEEL kgs")).alias("typed"))
    return spell.correct_texts(rows, "typed", spell.term_frequencies(part, "p_name")).select("p_partkey", "corrected")


def embedding_refresh_summary(spark: SparkSession, d: str) -> DataFrame:
    """Writes and publishes a version of the items' vectors, and says what it holds."""
    embedder = vectors.HashedTokens(128)
    rows = views.items(spark, d).select("row_no", "text", "numeric")
    kept = store.Store(spark, f"{shared.shared_dir(spark).rstrip('/')}/items-{uuid.uuid4().hex}")
    made = kept.reuse_or_write(rows, embedder.name, lambda r: vectors.embed(r, "text", embedder))
    return kept.read().agg(F.count("*").alias("total"), F.max(F.size("embedding")).cast("long").alias("dim")).withColumn("model", F.lit(made.model)).withColumn("status", F.lit(made.status))


def embedding_refresh_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Refreshes a store of all items after one item's text has changed: its ranges, and which of them were made again."""
    embedder = vectors.HashedTokens(128)
    rows = shared.stored(views.items(spark, d).select("row_no", "text"))
    kept = ranges.RangedStore(spark, f"{shared.shared_dir(spark).rstrip('/')}/ranges-{uuid.uuid4().hex}", size=256)
    make = lambda r: vectors.embed(r, "text", embedder)
    kept.refresh(rows, embedder.name, make)
    last = rows.agg(F.max("row_no").alias("last"))
    changed = rows.join(last, F.col("row_no") == F.col("last"), "left").select("row_no", F.when(F.col("last").isNotNull(), F.concat("text", F.lit(" changed"))).otherwise(F.col("text")).alias("text"))
    made = kept.refresh(changed, embedder.name, make).summary
    of_range = kept.read().groupBy(F.floor((F.col("row_no") - 1) / 256).alias("range_no")).agg(F.max("text").alias("last_text"), F.max(F.length("text")).cast("long").alias("longest"))
    return kept.ranges().select("range_no", "n", (F.col("folder") == made.version).alias("made_again")).join(of_range, "range_no")


def vendor_components_updated(spark: SparkSession, d: str) -> DataFrame:
    """Vendors that share identifiers, directly or through others: a batch of links for each identifier, one after another."""
    report = shared.stored(grouping.field_report(views.vendors(spark, d), views.FIELDS).select("field", "id", "group_min"))
    kept = component_store.ComponentStore(spark, f"{shared.shared_dir(spark).rstrip('/')}/components-{uuid.uuid4().hex}", parts=16)
    for field in views.FIELDS:
        kept.add(report.where(F.col("field") == field), "id", "group_min")
    return kept.read()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import service

    return service.queries() | {
        f.__name__: f
        for f in (
            vendor_identifier_groups, vendor_field_report, vendor_field_totals, vendor_name_groups, vendor_duplicate_report, vendor_duplicate_totals, vendor_identifier_probe, vendor_name_probe,
            clean_str, normalize_identifier, uom_canonical, item_text_numeric_split, item_normalize_full, item_scan_ordered, catalog_scan,
            approval_union, rows_round_trip, vector_pairs_blocked, vector_pairs_unblocked, vector_exact_groups, vector_components, vector_probe,
            item_duplicate_report, item_duplicate_report_nested, item_duplicate_report_records, item_match_counts, item_bulk_summary, item_quality_score, item_column_status, item_variant_probe, item_variant_probe_indexed, vendor_name_probe_indexed, item_bulk_check,
            item_bulk_groups, catalog_probe, uom_cascade, next_refresh_slot, spell_correct, embedding_refresh_summary, embedding_refresh_ranges, vendor_components_updated,
        )
    }


def oracle_sql() -> dict[str, str]:
    from . import service_oracle
    from .oracle import SQL

    return SQL | service_oracle.SQL

"""Queries of the engine's operations and of the scans, caches and records beneath them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Engine
from ..functions import text, vectors
from ..sources import shared, store, tables
from . import records, views

TERMS = (("small", 900), ("large", 800), ("ring", 600), ("bolt", 500), ("widget", 400))
BATCH = ("small  RING 11mm", "Ring small, 11 mm", "bolt blue 5mm", "new anvil 77mm", "old rod 20 MM", "")
IDENTIFIERS = {"CNIC": "11123-2222123 1", "NTN": "0123", "STRN": "st 123", "Account No": "AC-123", "IBAN": "pk36-scbl-0000000123"}
CODES = ("brand#7", "Economy", " ", "brand 7")
LABELS = ((1, "Kilogram"), (2, "Odd Unit"), (3, ""), (4, "Mtr"))
UNIT_VALUES = ("kgs", "unit ODD", "%", "metres")


def item_view(spark: SparkSession, d: str) -> DataFrame:
    """Items as a database has them; every third has a code, every fourth a unit, and suppliers have gaps."""
    part = views.table(spark, d, "part")
    return part.select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("ITEM_TYPE"), F.col("p_brand").alias("MAINGROUP"), F.regexp_extract("p_name", "([^ ]+)$", 1).alias("SUBGROUP"),
        F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("mm")).alias("ITEMDESC"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("C"), "p_partkey")).alias("ITEM_CODE"), F.when(F.col("p_partkey") % 4 == 0, F.lit("pcs")).alias("UOM"),
        F.when(F.col("p_partkey") % 5 != 0, F.lit("sup")).alias("Supplier"),
    )


def vendor_view(spark: SparkSession, d: str) -> DataFrame:
    v = views.vendors(spark, d)
    return v.select("id", "Name", "CNIC", "NTN", F.col("STRN").alias("SalesTaxNo"), "AccountNo", F.col("IBAN").alias("IbanNO"))


def _queue(view: DataFrame) -> DataFrame:
    return view.where("id % 10 = 0")


def _engine(spark: SparkSession) -> Engine:
    path = f"{shared.shared_dir(spark).rstrip('/')}/engine-{uuid.uuid4().hex}"
    return Engine(spark, path, vectors.HashedTokens(), terms=TERMS)


def _matches(answers: DataFrame) -> DataFrame:
    """The matches of answers, a row each; a candidate without any has one of nulls."""
    return answers.select("cand", "status", F.explode_outer("matches").alias("m")).select("cand", "status", "m.*")


def vendor_scan(spark: SparkSession, d: str) -> DataFrame:
    return tables.vendor_rows(vendor_view(spark, d), "Name DESC, id")


def vendor_approval_scan(spark: SparkSession, d: str) -> DataFrame:
    return tables.vendor_rows(_queue(vendor_view(spark, d)))


def item_scan_without_id(spark: SparkSession, d: str) -> DataFrame:
    """Without an id, rows are numbered in the order of their four columns."""
    return tables.item_rows(item_view(spark, d).drop("id"))


def item_scan_first(spark: SparkSession, d: str) -> DataFrame:
    return tables.item_rows(item_view(spark, d), "id DESC", extras=True, limit=100)


def item_cache_rows(spark: SparkSession, d: str) -> DataFrame:
    """What is kept of each item: parts, display columns and the optional ones that its code allows."""
    kept = records.schema_records(tables.item_rows(item_view(spark, d), extras=True))
    return records.cache_rows(records.minimized(kept, compose=False))


def item_json_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Records without their private columns, written as JSON arrays and read back."""
    kept = records.schema_records(tables.item_rows(item_view(spark, d), extras=True))
    rows = store.without_private(records.minimized(kept, compose=False))
    path = f"{shared.shared_dir(spark).rstrip('/')}/arrays-{uuid.uuid4().hex}"
    store.write_json_arrays(rows, path)
    return spark.read.schema(rows.schema).option("multiLine", "true").json(path)


def token_classes(spark: SparkSession, d: str) -> DataFrame:
    """Which tokens are dimensions or units, and their bare form."""
    shapes = F.array(*[F.expr(e) for e in ("p_size || 'mm'", "p_size || 'X2in'", "p_size || '/2'", "p_size || '\"x3\"'", "p_type", "'Kg'", "'vdc'", "'(w:)'")])
    token = F.element_at(shapes, (F.col("p_partkey") % 8 + 1).cast("int"))
    part = views.table(spark, d, "part").select("p_partkey", token.alias("token"))
    return part.select("p_partkey", text.is_dimension(F.col("token")).alias("dimension"), text.is_unit(F.col("token")).alias("unit"), text.bare_token(F.col("token")).alias("bare"))


def embedding_cache_action(spark: SparkSession, d: str) -> DataFrame:
    """What a writer does before the first version, then with the same rows, with another model, with changed texts, and when forced."""
    embedder = vectors.HashedTokens(64)
    rows = shared.stored(views.items(spark, d).select("row_no", "text"))
    kept = store.Store(spark, f"{shared.shared_dir(spark).rstrip('/')}/action-{uuid.uuid4().hex}")
    n, digest = rows.count(), store.text_digest(rows)
    before = store.cache_action(kept.summary(), embedder.name, n, digest)
    found = kept.reuse_or_write(rows, embedder.name, lambda r: vectors.embed(r, "text", embedder))
    changed = store.text_digest(rows.withColumn("text", F.concat("text", F.lit("s"))))
    done = [
        ("first", before), ("same", store.cache_action(found, embedder.name, n, digest)), ("other model", store.cache_action(found, "other", n, digest)),
        ("changed", store.cache_action(found, embedder.name, n, changed)), ("forced", store.cache_action(found, embedder.name, n, digest, force=True)),
    ]
    return spark.createDataFrame(done, "state string, action string")


def engine_item_groups(spark: SparkSession, d: str) -> DataFrame:
    """All items embedded and published, and the members of the report's groups."""
    engine = _engine(spark)
    engine.item_update_embeddings(item_view(spark, d))
    groups = engine.item_duplicate_engine()[1]
    return groups.select("group_id", "status.ITEM_TYPE", F.explode("records.row_no").alias("row_no"))


def engine_item_totals(spark: SparkSession, d: str) -> DataFrame:
    engine = _engine(spark)
    engine.item_update_embeddings(item_view(spark, d))
    return engine.item_duplicate_engine()[0]


def engine_item_variant(spark: SparkSession, d: str) -> DataFrame:
    """A misspelt description against published items and the queue."""
    view, engine = item_view(spark, d), _engine(spark)
    engine.item_update_embeddings(view)
    return _matches(engine.item_check_duplicate_variant("SMLAL rnig, 11mm", _queue(view)))


def engine_item_bulk(spark: SparkSession, d: str) -> DataFrame:
    """The answers for a batch: the first of each of its groups, and what is in none."""
    view, engine = item_view(spark, d), _engine(spark)
    engine.item_update_embeddings(view)
    results = engine.item_check_duplicate_bulk(list(BATCH), _queue(view))["results"]
    return results.select("cand", "status", F.size("matches").cast("long").alias("n_matches"))


def engine_vendor_report(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark).vendor_duplicate_engine(vendor_view(spark, d))[0]


def engine_vendor_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """The five checks of an identifier against the vendors and their queue."""
    view = vendor_view(spark, d)
    answers = _engine(spark).vendor_check_identifiers(IDENTIFIERS, view, _queue(view))
    return answers.select("label", "status", F.explode_outer("matches").alias("m")).select("status", "m.*", "label")


def engine_vendor_name(spark: SparkSession, d: str) -> DataFrame:
    """A name, its words in another order, against published vendors and the queue."""
    view, engine = vendor_view(spark, d), _engine(spark)
    engine.vendor_update_embeddings(view)
    return _matches(engine.vendor_check_duplicate_name("12 BUILDING vendor", _queue(view)))


def engine_codes(spark: SparkSession, d: str) -> DataFrame:
    """Main and sub codes against catalogs of brands and types."""
    part, engine = views.table(spark, d, "part"), _engine(spark)
    main = part.select(F.col("p_brand").alias("ItemMainCode_Name")).distinct()
    sub = part.select(F.col("p_type").alias("ItemSubCode_Name")).distinct()
    out = None
    for value in CODES:
        for kind, rows in (("main", engine.main_code_check_duplicate_variant(value, main)), ("sub", engine.sub_code_check_duplicate_variant(value, sub))):
            found = _matches(rows).select(F.lit(kind).alias("kind"), F.lit(value).alias("value"), "status", "name")
            out = found if out is None else out.unionByName(found)
    return out


def engine_units(spark: SparkSession, d: str) -> DataFrame:
    """Units by canonical code or, where none has it, by a similar label; the catalog has a label for each brand beside its own."""
    engine = _engine(spark)
    brands = views.table(spark, d, "part").select(F.lit(0).cast("long").alias("id"), F.col("p_brand").alias("UOM_Description")).distinct()
    labels = spark.createDataFrame(list(LABELS), "id long, UOM_Description string").unionByName(brands)
    labels = shared.stored(labels)  # read for each value
    out = None
    for value in UNIT_VALUES:
        found = _matches(engine.uom_check_duplicate_variant(value, labels)).select(F.lit(value).alias("value"), "status", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("row#", F.lit(-1)).alias("id"))
        out = found if out is None else out.unionByName(found)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            vendor_scan, vendor_approval_scan, item_scan_without_id, item_scan_first, item_cache_rows, item_json_arrays, token_classes, embedding_cache_action, engine_item_groups,
            engine_item_totals, engine_item_variant, engine_item_bulk, engine_vendor_report, engine_vendor_identifiers, engine_vendor_name, engine_codes, engine_units,
        )
    }

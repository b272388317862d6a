import pytest
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import functions as F

from kinmatch.api import Engine
from kinmatch.config import Settings, read_env_file
from kinmatch.functions.vectors import HashedTokens, embed

ITEM = "id long, ITEM_TYPE string, MAINGROUP string, SUBGROUP string, ITEMDESC string, ITEM_CODE string, UOM string, Supplier string"
VENDOR = "id long, Name string, CNIC string, NTN string, SalesTaxNo string, AccountNo string, IbanNO string"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    made = Engine(spark, str(tmp_path_factory.mktemp("engine")), terms=[("bolt", 9), ("valve", 5), ("steel", 3)])
    items = [
        (1, "a", "m", "s", "BOLT STEEL 20mm", "c1", "pcs", "x"), (2, "a", "m", "s", "steel bolt 20 MM", None, "kg", "y"), (3, "b", "m", "s", "bolt steel 30mm", "c3", None, None),
        (4, "b", "n", "s", "valve 1/2IN", "c4", "pcs", "z"), (5, None, None, None, None, None, None, None), (6, "q", "m", "s", "", None, None, None),
    ]
    made.item_update_embeddings(spark.createDataFrame(items, ITEM))
    return made


@pytest.fixture(scope="module")
def queue(spark):
    return spark.createDataFrame([(1, "a", "m", "s", "Bolt Steel 20mm"), (2, "a", "m", "s", "other")], "id long, ITEM_TYPE string, MAINGROUP string, SUBGROUP string, ITEMDESC string")


@pytest.fixture(scope="module")
def vendors(spark):
    rows = [(1, "Acme Trading", "12345-1", "007", "s1", None, "i1"), (2, "ACME trading", "123451", "7", "s2", "", "i2"), (3, "Other", "9", None, "s1", "-", "i3")]
    return spark.createDataFrame(rows, VENDOR)


def listed(df):
    r = df.first()
    return r["status"], [tuple(m) for m in r["matches"]]


def test_item_report(engine):
    totals, groups = engine.item_duplicate_engine()
    assert totals.first().asDict() == {"total_records": 6, "valid_records": 4, "duplicate_records": 2, "Data_quality_score": 66.67}
    rows = {r["group_id"]: r for r in groups.collect()}
    assert [r["row_no"] for r in rows["DUP_1"]["records"]] == [1, 2] and [r["row_no"] for r in rows["DUP_2"]["records"]] == [5, 6]
    assert rows["DUP_1"]["status"].asDict() == {"ITEM_TYPE": "exact", "MAINGROUP": "exact", "SUBGROUP": "exact", "ITEMDESC": "different"}
    second = rows["DUP_1"]["records"][1]
    assert (second["ITEM_CODE"], second["UOM"], second["Supplier"]) == ("", "kg", "")  # without a code, the supplier goes


def test_item_probe(engine, queue):
    status, matches = listed(engine.item_check_duplicate_variant("botl STEEL, 20mm", queue))
    assert status == "duplicate"
    assert [(place, n) for _, place, n in matches] == [("db", 1), ("db", 2), ("approval", 1)]
    assert listed(engine.item_check_duplicate_variant("gear 99")) == ("unique", [])


def test_bulk(engine, queue):
    made = engine.item_check_duplicate_bulk(["valve 1/2IN", "new thing 7", "Thing  new 7", "steel bolt 30mm"], queue)
    assert tuple(made["summary"].first()) == (4, 3)
    assert [(r[0], r[1]) for r in made["groups"].collect()] == [(1, [2])]
    assert {r["cand"]: r["status"] for r in made["results"].collect()} == {0: "duplicate", 1: "unique", 3: "duplicate"}
    with pytest.raises(ValueError):
        engine.item_check_duplicate_bulk([])


def test_vendors(engine, vendors):
    totals, _ = engine.vendor_duplicate_engine(vendors)
    assert {r["field"]: (r["duplicate_groups"], r["duplicate_records"]) for r in totals.collect()} == {"NAME": (1, 1), "CNIC": (1, 1), "NTN": (1, 1), "STRN": (1, 1)}
    assert engine.vendors.summary() is None  # a report writes nothing
    with pytest.raises(RuntimeError):
        engine.vendor_check_duplicate_name("acme", vendors)
    engine.vendor_update_embeddings(vendors)
    status, matches = listed(engine.vendor_check_duplicate_name("trading Acme", vendors.where("id = 2")))
    assert status == "duplicate" and [(m[0], m[2]) for m in matches] == [(1, "db"), (2, "db"), (2, "approval")]
    status, matches = listed(engine.vendor_check_duplicate("CNIC", "123 45 1", vendors, vendors.where("id = 1")))
    assert status == "duplicate" and [(m[0], m[3], m[4]) for m in matches] == [(1, "db", 1), (2, "db", 2), (1, "approval", 1)]
    for empty in ("", "-", None):
        assert listed(engine.vendor_check_duplicate("Account No", empty, vendors, vendors)) == ("unique", [])


def test_catalogs(engine, spark):
    codes = spark.createDataFrame([(7, "Steel Valve"), (8, None)], "id long, ItemMainCode_Name string")
    assert listed(engine.main_code_check_duplicate_variant("vavle steel", codes)) == ("duplicate", [("Steel Valve", 7)])
    assert listed(engine.main_code_check_duplicate_variant("  ", codes)) == ("unique", [])
    assert listed(engine.sub_code_check_duplicate_variant("gear", codes.withColumnRenamed("ItemMainCode_Name", "ItemSubCode_Name"))) == ("unique", [])
    units = spark.createDataFrame([(1, "Kilogram"), (2, "Odd Unit"), (3, "")], "id long, UOM_Description string")
    assert listed(engine.uom_check_duplicate_variant("kgs", units)) == ("duplicate", [("Kilogram", 1)])
    assert listed(engine.uom_check_duplicate_variant("unit odd", units)) == ("duplicate", [("Odd Unit", 2)])
    assert listed(engine.uom_check_duplicate_variant("%", units)) == ("unique", [])


def test_settings():
    assert Settings.from_env({"KINMATCH_ITEM_PROBE": "0.8", "KINMATCH_PASSES": "3"}) == Settings(item_probe=0.8, passes=3)
    assert read_env_file("A=1\n# B=2\nexport C='x y'\nD=\"q\nE=2", {"E": "1"}) == {"A": "1", "C": "x y", "D": '"q'}


def counted(spark, width=16):
    """An embedder, how many texts it was given, and a list of how many at a time."""

    class Lists(AccumulatorParam):
        def zero(self, value):
            return []

        def addInPlace(self, a, b):
            return a + b

    seen, most = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator([], Lists())

    def model(texts):
        seen.add(len(texts))
        most.add([len(texts)])
        return HashedTokens(width)(texts)

    model.name, model.width = HashedTokens(width).name, width
    return model, seen, most


def test_a_report_embeds_each_name_once(spark, tmp_path):
    """900 vendors of 300 names: 300 vectors, made a few texts at a time."""
    model, seen, most = counted(spark)
    made = Engine(spark, str(tmp_path), model)
    rows = spark.range(900).coalesce(1).select("id", F.expr("concat('n', id % 300)").alias("Name"), *[F.lit(None).cast("string").alias(c) for c in ("CNIC", "NTN", "SalesTaxNo", "AccountNo", "IbanNO")])
    totals, _ = made.vendor_duplicate_engine(rows)
    found = totals.first()
    assert seen.value == 300 and max(most.value) <= 256
    assert (found["field"], found["duplicate_groups"] >= 1, found["duplicate_records"] >= 600) == ("NAME", True, True)


def test_vectors_are_made_a_few_texts_at_a_time(spark):
    """Of a batch of 2,000 rows, no more than 256 texts are made into vectors at once; rows keep their columns."""
    model, seen, most = counted(spark)
    rows = spark.range(2000).coalesce(1).select("id", F.when(F.col("id") % 7 > 0, F.expr("concat('t ', id)")).alias("text"), F.array("id").alias("other"))
    out = embed(rows, "text", model).collect()
    assert seen.value == 2000 and max(most.value) <= 256
    want = HashedTokens(16)([r["text"] or "" for r in out])
    assert [r["id"] for r in out] == [r["other"][0] for r in out] == list(range(2000))
    assert all(list(w) == r["embedding"] for w, r in zip(want.tolist(), out))


def passing(spark, kind):
    """A function that returns its argument, and how often it was called."""
    seen = spark.sparkContext.accumulator(0)

    def same(x):
        seen.add(1)
        return x

    return F.udf(same, kind), seen


def test_units_are_made_ready_once_a_label(spark, tmp_path):
    """A catalog is a distinct of 3,000 rows with three labels: only labels are normalised, not the rows beneath."""
    same, seen = passing(spark, "string")

    class Counting(Engine):
        def _ready(self, c):
            return same(super()._ready(c))

    made = Counting(spark, str(tmp_path))
    labels = spark.range(3000).select((F.col("id") % 3).alias("id"), F.expr("element_at(array('Kilogram', 'Odd Unit', 'Box'), cast(id % 3 + 1 as int))").alias("UOM_Description")).distinct()
    assert listed(made.uom_check_duplicate_variant("kgs", labels)) == ("duplicate", [("Kilogram", 0)])
    assert listed(made.uom_check_duplicate_variant("unit odd", labels)) == ("duplicate", [("Odd Unit", 1)])
    assert seen.value < 100


def test_several_identifiers_read_vendors_once(engine, spark, vendors):
    """Five identifiers have the answers of five checks; rows are read to be dealt and numbered, not again for each."""
    same, seen = passing(spark, "long")
    asked = {"CNIC": "123 45 1", "NTN": "0007", "STRN": "S-1", "Account No": " - ", "IBAN": "i9"}
    counted_view = vendors.withColumn("id", same("id"))
    got = {r["label"]: (r["status"], [tuple(m) for m in r["matches"]]) for r in engine.vendor_check_identifiers(asked, counted_view, vendors.where("id = 1")).collect()}
    assert seen.value <= 3 * 3
    assert got == {k: listed(engine.vendor_check_duplicate(k, v, vendors, vendors.where("id = 1"))) for k, v in asked.items()}
    assert [(m[0], m[3]) for m in got["STRN"][1]] == [(1, "db"), (3, "db"), (1, "approval")] and got["IBAN"] == got["Account No"] == ("unique", [])


def test_items_and_their_queue_are_embedded_a_few_at_a_time(spark, tmp_path):
    """3,000 items and a queue of 1,500, published, probed by one and by a batch, and grouped: never over 256 vectors at once."""
    model, seen, most = counted(spark)
    made = Engine(spark, str(tmp_path), model)
    view = spark.range(3000).coalesce(1).select("id", *[F.lit("x").alias(c) for c in ("ITEM_TYPE", "MAINGROUP", "SUBGROUP")], F.expr("concat('bolt ', id % 500 + 1, 'mm')").alias("ITEMDESC"))
    queue = view.where("id < 1500")
    made.item_update_embeddings(view)
    assert seen.value == 3000
    status, matches = listed(made.item_check_duplicate_variant("bolt 7mm", queue))
    assert (status, len(matches)) == ("duplicate", 9)
    results = made.item_check_duplicate_bulk(["bolt 7mm", "Bolt 7 mm", "nut 9mm"], queue)["results"].orderBy("cand").collect()
    assert [(r["cand"], r["status"], len(r["matches"])) for r in results] == [(0, "duplicate", 9), (2, "unique", 0)]
    assert made.item_duplicate_engine()[0].first()["duplicate_records"] == 2500
    assert max(most.value) <= 256


def test_vendors_and_their_queue_are_embedded_a_few_at_a_time(spark, tmp_path):
    model, seen, most = counted(spark)
    made = Engine(spark, str(tmp_path), model)
    rows = spark.range(3000).coalesce(1).select("id", F.expr("concat('n', id % 300)").alias("Name"), *[F.lit(None).cast("string").alias(c) for c in ("CNIC", "NTN", "SalesTaxNo", "AccountNo", "IbanNO")])
    made.vendor_update_embeddings(rows)
    status, matches = listed(made.vendor_check_duplicate_name("N7", rows.where("id < 1500")))
    assert (status, seen.value >= 4500, max(most.value) <= 256) == ("duplicate", True, True)
    assert len([m for m in matches if m[1] == "n7"]) == 15


def test_of_a_queue_only_rows_with_a_candidate_s_numbers_are_embedded(spark, tmp_path):
    """1,500 rows of 500 numbers: a probe by one number needs the vectors of 3, a batch of three numbers those of 6, as 600 is none of theirs."""
    model, seen, _ = counted(spark)
    made = Engine(spark, str(tmp_path), model)
    view = spark.range(3000).coalesce(1).select("id", *[F.lit("x").alias(c) for c in ("ITEM_TYPE", "MAINGROUP", "SUBGROUP")], F.expr("concat('bolt ', id % 500 + 1, 'mm')").alias("ITEMDESC"))
    queue = view.where("id < 1500")
    made.item_update_embeddings(view)
    before = seen.value
    status, matches = listed(made.item_check_duplicate_variant("bolt 7mm", queue))
    assert (status, len(matches), seen.value - before) == ("duplicate", 9, 3 + 1)
    before = seen.value
    results = made.item_check_duplicate_bulk(["bolt 7mm", "nut 9mm", "bolt 600mm", "bolt"], queue)["results"].orderBy("cand").collect()
    assert [(r["cand"], r["status"], len(r["matches"])) for r in results] == [(0, "duplicate", 9), (1, "unique", 0), (2, "unique", 0), (3, "unique", 0)]
    assert seen.value - before == 6 + 4


def test_rows_without_numbers_are_probed(spark, tmp_path):
    """A candidate without numbers meets rows without, a null description among them, in both places."""
    made = Engine(spark, str(tmp_path), HashedTokens(64))
    rows = [(1, "bolt"), (2, None), (3, "bolt 5mm"), (4, "")]
    view = spark.createDataFrame(rows, "id long, ITEMDESC string").select("id", *[F.lit("x").alias(c) for c in ("ITEM_TYPE", "MAINGROUP", "SUBGROUP")], "ITEMDESC")
    made.item_update_embeddings(view)
    status, matches = listed(made.item_check_duplicate_variant("Bolt", view))
    assert (status, [m[1:] for m in matches]) == ("duplicate", [("db", 1), ("approval", 1)])


def test_a_name_is_compared_once_a_distinct_text(spark, tmp_path, monkeypatch):
    """3,000 vendors and a queue of 1,500, of 300 names and null: 301 vectors are compared, and all rows of a name are found."""
    from kinmatch import api

    compared = []
    probe = api.vector_probe
    monkeypatch.setattr(api, "vector_probe", lambda given, rows, *a, **k: compared.append(rows.count()) or probe(given, rows, *a, **k))
    made = Engine(spark, str(tmp_path), HashedTokens(64))
    name = F.expr("CASE WHEN id % 1000 <> 999 THEN concat('n', id % 300, ' ltd') END").alias("Name")
    rows = spark.range(3000).select("id", name, *[F.lit(None).cast("string").alias(c) for c in ("CNIC", "NTN", "SalesTaxNo", "AccountNo", "IbanNO")])
    made.vendor_update_embeddings(rows)
    status, matches = listed(made.vendor_check_duplicate_name("LTD n7", rows.where("id < 1500")))
    want = [(i, "n7 ltd", "db", i + 1) for i in range(7, 3000, 300)] + [(i, "n7 ltd", "approval", i + 1) for i in range(7, 1500, 300)]
    assert (status, matches, compared) == ("duplicate", want, [301])

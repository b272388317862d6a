import pytest
from pyspark.sql import functions as F

from kinmatch.functions.vectors import HashedTokens, embed
from kinmatch.sources import store, tables


def test_order_clauses(spark):
    df = spark.createDataFrame([(2, None), (None, "b"), (1, "a")], "id long, x string")
    first = lambda clause: [tuple(r) for r in df.orderBy(*tables.order_by(clause, df)).collect()]
    assert first(None) == first("id NULLS LAST") == first('"id" NULLS LAST') == first('id" NULLS LAST') == [(1, "a"), (2, None), (None, "b")]
    assert first("x desc nulls first, id")[0] == (2, None)
    with pytest.raises(ValueError):
        tables.order_by("id; drop table x", df)


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = {r["k"]: r["row_no"] for r in tables.with_row_no(df, [F.col("k").desc()]).collect()}
    assert got == {k: 1000 - k for k in range(1000)}
    assert tables.with_row_no(df.where("false"), [F.col("k")]).count() == 0


def test_missing_columns(spark):
    with pytest.raises(KeyError):
        tables.require(spark.range(1), ["id", "nope"])
    with pytest.raises(KeyError):
        tables.item_rows(spark.range(1))


def test_scans(spark):
    items = spark.createDataFrame([(2, "t", "m", "s", "d2"), (1, "t", "m", "s", None)], "id long, ITEM_TYPE string, MAINGROUP string, SUBGROUP string, ITEMDESC string")
    assert [tuple(r) for r in tables.item_rows(items).orderBy("row_no").collect()] == [(1, "t", "m", "s", None), (2, "t", "m", "s", "d2")]
    assert tables.item_rows(items, limit=1).count() == 1
    catalog = spark.createDataFrame([(None, " a "), (3, None)], "ID long, name string")
    assert sorted(map(tuple, tables.catalog_rows(catalog, "name").collect())) == [(0, "a"), (3, "")]
    assert [tuple(r) for r in tables.catalog_rows(catalog.select("name"), "name").collect()] == [(1, "a"), (2, "")]


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([(1, "red bolt"), (2, None)], "row_no long, text string")
    model = HashedTokens(16)
    kept = store.Store(spark, str(tmp_path / "s"))
    assert kept.summary() is None
    with pytest.raises(FileNotFoundError):
        kept.read()
    with pytest.raises(RuntimeError, match="no version"):
        kept.reuse_or_write(rows, model.name, None, mode="reuse_only")
    make = lambda r: embed(r, "text", model)
    first = kept.reuse_or_write(rows, model.name, make)
    assert (first.rows, first.dim, first.model) == (2, 16, model.name)
    assert kept.reuse_or_write(rows, model.name, make) == first
    changed = rows.withColumn("text", F.lit("other"))
    assert store.mismatches(first, model.name, 2, store.text_digest(changed)) == ["texts have changed"]
    second = kept.reuse_or_write(changed, model.name, make)
    assert second.version != first.version and kept.read().where("text = 'other'").count() == 2
    with pytest.raises(Exception, match="boom|UNRESOLVED|cannot"):
        kept.reuse_or_write(rows, model.name, lambda r: r.select("boom"), mode="force_recompute")
    assert kept.summary() == second
    assert store.mismatches(second, "m", 3)[0].startswith("model is")


def test_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([("1", None)], "a string, b string")
    store.write_json_lines(rows, str(tmp_path / "j"))
    assert '"b":null' in "".join(r[0] for r in spark.read.text(str(tmp_path / "j")).collect())
    assert [tuple(r) for r in tables.read_json_lines(spark, str(tmp_path / "j"), ["a", "b"]).collect()] == [("1", None)]


def test_json_arrays(spark, tmp_path):
    import json

    rows = spark.createDataFrame([("1", None), ("2", 'x"y')], "a string, b string").coalesce(1)
    store.write_json_arrays(rows, str(tmp_path / "a"))
    files = list((tmp_path / "a").glob("*.txt"))
    assert [json.loads(f.read_text()) for f in files] == [[{"a": "1", "b": None}, {"a": "2", "b": 'x"y'}]]
    store.write_json_arrays(rows.limit(0), str(tmp_path / "e"))
    assert all(f.read_text().strip() in ("", "[]") for f in (tmp_path / "e").glob("*.txt"))
    assert spark.read.schema(rows.schema).option("multiLine", "true").json(str(tmp_path / "e")).count() == 0


def test_lines_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"a": "1"}\n\n{nope\n')
    with pytest.raises(Exception, match="FAILFAST|Malformed|MALFORMED"):
        tables.read_json_lines(spark, str(tmp_path / "l.json"), ["a"]).collect()


def test_lines_without_display_columns_warn(spark, tmp_path, caplog):
    tables.read_json_lines(spark, str(tmp_path), ["a"])
    assert "display columns" in caplog.text


def test_names_with_backticks(spark):
    df = spark.createDataFrame([(1, 2)], ["a`b", "c"])
    assert tables.require(df, ["a`b"]).first()[0] == 1


def test_cache_actions():
    made = store.Summary("v", "m", 2, 16, "d")
    assert store.cache_action(None, "m", 2) == "missing"
    assert store.cache_action(made, "m", 2, "d") == "reuse"
    assert {store.cache_action(made, "m", 2, "d", force=True), store.cache_action(made, "n", 2), store.cache_action(made, "m", 2, "e"), store.cache_action(made, "m", 3)} == {"compute"}
    assert store.guard(made, "m", 16) == made
    for found, model, dim in ((None, "m", None), (made, "n", None), (made, "m", 8)):
        with pytest.raises(RuntimeError):
            store.guard(found, model, dim)


def test_vectors_of_two_lengths_are_not_published(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "u"))
    rows = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [1.0, 2.0])], "row_no long, text string, embedding array<float>")
    with pytest.raises(ValueError, match="1 to 2"):
        kept.write(rows, "m")
    assert kept.summary() is None

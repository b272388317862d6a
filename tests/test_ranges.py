import pytest
from pyspark.sql import functions as F

from kinmatch.functions.vectors import HashedTokens, embed
from kinmatch.sources.ranges import RangedStore
from kinmatch.sources.store import Store

MODEL = HashedTokens(16)


def rows_of(df):
    return sorted((r["row_no"] is not None, r["row_no"] or 0, r["text"] or "", tuple(r["embedding"])) for r in df.collect())


def with_vectors(r):
    return embed(r, "text", MODEL)


def texts(spark, n):
    return spark.range(1, n + 1).select(F.col("id").alias("row_no"), F.concat(F.lit("text "), (F.col("id") % 50).cast("string")).alias("text"))


def test_one_changed_row_makes_one_range(spark, tmp_path):
    rows = texts(spark, 20_000)
    kept = RangedStore(spark, str(tmp_path / "s"))
    first = kept.refresh(rows, MODEL.name, with_vectors)
    assert (first.made, first.kept, first.summary.rows, first.summary.dim) == (5, 0, 20_000, 16)
    assert kept.refresh(rows, MODEL.name, with_vectors) == type(first)(first.summary, 0, 5)
    seen = spark.sparkContext.accumulator(0)

    def counted(r):
        def model(given):
            seen.add(len(given))
            return HashedTokens(16)(given)

        return embed(r, "text", model)

    changed = rows.withColumn("text", F.when(F.col("row_no") == 9000, "quite another").otherwise(F.col("text")))
    second = kept.refresh(changed, MODEL.name, counted)
    assert (second.made, second.kept, seen.value) == (1, 4, 4096)
    whole = Store(spark, str(tmp_path / "w"))
    full = whole.write(with_vectors(changed), MODEL.name)
    same = lambda s: (s.model, s.rows, s.dim, s.text_digest, s.status)
    assert same(second.summary) == same(full)
    assert rows_of(kept.read()) == rows_of(whole.read())
    assert {(r["range_no"], r["folder"] == second.summary.version) for r in kept.ranges().collect()} == {(i, i == 2) for i in range(5)}


def test_rows_that_come_and_go_and_folders_copied_together(spark, tmp_path):
    kept = RangedStore(spark, str(tmp_path / "s"), size=10, folders=3)
    kept.refresh(texts(spark, 35), MODEL.name, with_vectors)
    for n, made, n_kept in ((45, 2, 3), (20, 0, 2), (50, 3, 2), (51, 1, 5), (0, 0, 0), (5, 1, 0)):
        rows = texts(spark, n)
        got = kept.refresh(rows, MODEL.name, with_vectors)
        assert (n, got.made, got.kept, got.summary.rows) == (n, made, n_kept, n)
        assert rows_of(kept.read()) == rows_of(with_vectors(rows))
        assert kept.ranges().select("folder").distinct().count() <= 3
    other = HashedTokens(8)
    assert kept.refresh(rows, other.name, lambda r: embed(r, "text", other)).made == 1
    swept = kept.sweep(0)
    assert swept and kept.sweep(0) == [] and kept.read().count() == 5


def test_edge_cases(spark, tmp_path):
    """Rows without a number or text, repeated rows, other columns; what fails leaves the version as it was."""
    data = [(None, "a", 1), (1, None, 2), (1, None, 2), (2, "x" * 100_000, 3), (-5, "b", 4)]
    rows = spark.createDataFrame(data, "row_no long, text string, folder_ int")
    kept = RangedStore(spark, str(tmp_path / "s"), size=2)
    first = kept.refresh(rows, MODEL.name, with_vectors).summary
    assert rows_of(kept.read()) == rows_of(with_vectors(rows)) and kept.read().columns == ["row_no", "text", "folder_", "embedding"]
    more = rows.unionByName(spark.createDataFrame([(3, "c", 5)], rows.schema))
    with pytest.raises(ValueError, match="0 of 1 rows"):
        kept.refresh(more, MODEL.name, lambda r: with_vectors(r.where("row_no <> 3")))
    with pytest.raises(ValueError, match="8 to 16"):
        kept.refresh(more, MODEL.name, lambda r: embed(r, "text", HashedTokens(8)))
    assert kept.summary() == first and len(kept.sweep(0)) == 0


def test_ranges_share_files(spark, tmp_path):
    """500 ranges are written to as many files as there are partitions, at most."""
    kept = RangedStore(spark, str(tmp_path / "s"), size=4)
    made = kept.refresh(texts(spark, 2000), MODEL.name, with_vectors)
    assert made.made == 500 and len(list((tmp_path / "s").rglob("*.parquet"))) < 20
    changed = texts(spark, 2000).withColumn("text", F.when(F.col("row_no") == 9, "other").otherwise(F.col("text")))
    assert kept.refresh(changed, MODEL.name, with_vectors).made == 1
    assert rows_of(kept.read()) == rows_of(with_vectors(changed))

import pytest
from pyspark.sql import functions as F

from kinmatch.operators.probe_index import ProbeIndex, publish
from kinmatch.plans import reports


def items(spark, n, keys=400):
    """Items of some keys, each text of a few words, some blank, some repeated in the queue under other numbers."""
    word = lambda m, k: F.concat(F.lit("w"), (F.xxhash64("id", F.lit(k)) % m).cast("string"))
    text = F.when(F.col("id") % 97 == 0, "").otherwise(F.concat_ws(" ", F.lit("mm"), word(9, 1), word(40, 2), word(300, 3)))
    main = spark.range(n).select(F.col("id").alias("row_no"), text.alias("text"), (F.col("id") % keys).cast("string").alias("numeric"))
    queue = main.where("row_no % 7 = 0").withColumn("row_no", F.col("row_no") / 7 + 1).withColumn("row_no", F.col("row_no").cast("long"))
    return main.withColumn("location", F.lit("db")).unionByName(queue.withColumn("location", F.lit("approval")))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("cand", "location", "row_no").collect())


def candidates(spark, rows, share):
    asked = rows.where(f"location = 'db' AND row_no % {share} = 0")
    return asked.select(F.col("row_no").alias("cand"), F.regexp_replace("text", "mm", "MM  new").alias("text"), "numeric")


@pytest.mark.parametrize("share", [1500, 7])
def test_as_the_join_without_an_index(spark, tmp_path, share):
    rows = items(spark, 3000)
    publish(rows, str(tmp_path / "i"), 0.7, folder_rows=100)
    index = ProbeIndex(spark, str(tmp_path / "i"))
    assert index.folders > 20
    given = candidates(spark, rows, share)
    for threshold in (0.7, 0.85):
        want = rows_of(reports.text_matches(given, rows, threshold))
        assert want and rows_of(index.matches(given, threshold)) == want
    with pytest.raises(ValueError):
        index.matches(given, 0.6)


def records_read(spark, run):
    """Rows that all scans of a run read, by the status of its stages."""
    sc = spark.sparkContext
    store, gateway = sc._jsc.sc().statusStore(), sc._gateway
    none = lambda: gateway.jvm.java.util.ArrayList()
    seen = lambda: {s.stageId(): s.inputRecords() for s in map(stages().apply, range(stages().size()))}
    stages = lambda: store.stageList(none(), False, False, gateway.new_array(gateway.jvm.double, 0), none())
    before = set(seen())
    got = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return got, sum(n for i, n in seen().items() if i not in before)


def test_a_probe_reads_what_it_may_match(spark, tmp_path):
    """Three candidates read a small part of the rows; of four times as many rows with as many matches, no more."""
    read = []
    for n in (6_000, 24_000):
        rows = items(spark, n, keys=n // 15).where("text <> ''")
        index = publish(rows, str(tmp_path / str(n)), 0.75, folder_rows=100)
        given = candidates(spark, rows, 1).where("cand IN (11, 12, 13)")
        given = spark.createDataFrame(given.collect(), given.schema)
        got, some = records_read(spark, lambda: rows_of(index.matches(given)))  # noqa: B023
        assert {c for c, _, _ in got} == {11, 12, 13}
        read.append(some)
    assert read[1] < 1.3 * read[0] and read[1] < 24_000 / 6


def test_edge_cases(spark, tmp_path):
    """Nulls match nothing, blanks match blanks of their key, repeated rows count each, a candidate without a row finds none."""
    rows = spark.createDataFrame(
        [("db", 1, "", "5"), ("db", 2, None, "5"), ("db", 3, "a b", None), ("db", 4, "a b", "5"), ("db", 4, "a b", "5"), ("q", 4, "c d", "5"), ("q", 5, "a" * 50_000, "5")],
        "location string, row_no long, text string, numeric string",
    )
    given = spark.createDataFrame([(1, "", "5"), (2, "B a", "5"), (3, None, "5"), (4, "zz", "9"), (5, "A" * 50_000, "5")], "cand long, text string, numeric string")
    want = [(1, "db", 1), (2, "db", 4), (2, "db", 4), (5, "q", 5)]
    assert rows_of(publish(rows, str(tmp_path / "i"), 0.75).matches(given)) == want == rows_of(reports.text_matches(given, rows, 0.75))
    empty = publish(rows.where("false"), str(tmp_path / "e"), 0.75)
    assert rows_of(empty.matches(given)) == [] == rows_of(empty.matches(given.where("false")))


def test_rows_of_two_locations_with_one_number(spark, tmp_path):
    """Two texts whose rows have the same number in two locations aren't taken for one."""
    rows = spark.createDataFrame([("db", 1, "red bolt", "5"), ("q", 1, "blue ring", "5")], "location string, row_no long, text string, numeric string")
    given = spark.createDataFrame([(1, "red bolt", "5"), (2, "blue ring", "5")], "cand long, text string, numeric string")
    want = [(1, "db", 1), (2, "q", 1)]
    assert rows_of(reports.text_matches(given, rows, 0.9)) == want == rows_of(publish(rows, str(tmp_path / "i"), 0.9).matches(given))

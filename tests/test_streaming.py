import datetime as dt
import threading

import pytest

from kinmatch.functions.vectors import HashedTokens
from kinmatch.plans import views
from kinmatch.sources.store import Store
from kinmatch.streaming import probe, refresh


def drain(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_identifiers_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "00-12"), (2, "x/9"), (3, ""), (4, "77")], "cand long, value string").write.parquet(str(tmp_path / "in"))
    rows = spark.createDataFrame([("db", 10, "12"), ("approval", 11, "0012"), ("db", 12, "X9")], "location string, id long, ntn string")
    stream = spark.readStream.schema("cand long, value string").parquet(str(tmp_path / "in"))
    got = drain(probe.identifier_stream(stream, rows, "ntn"), "hits")
    assert sorted((r["cand"], r["location"], r["id"]) for r in got.collect()) == [(1, "approval", 11), (1, "db", 10), (2, "db", 12)]


def test_repeats_in_a_stream(spark, tmp_path):
    spark.sql("select * from values (1, 'a-1', timestamp'2024-01-01 00:00:00'), (2, 'A1', timestamp'2024-01-01 00:10:00'), (3, 'b', timestamp'2024-01-01 00:20:00') t(cand, value, ts)").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cand int, value string, ts timestamp").parquet(str(tmp_path / "in"))
    assert {r["cand"] for r in drain(probe.first_seen(stream), "firsts").collect()} in ({1, 3}, {2, 3})


def test_descriptions_of_a_stream(spark, sf, tmp_path):
    items = views.items(spark, sf).select("row_no", "text", "numeric")
    items.where("row_no < 5").withColumnRenamed("row_no", "cand").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cand long, text string, numeric string").parquet(str(tmp_path / "in"))
    probe.description_stream(stream, views.located(items, views.approval(items)), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    found = {(r["cand"], r["row_no"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {(i, i) for i in range(5)} <= found


def test_cycle(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(1, "a b")], "row_no long, text string")
    pauses = []

    def fails():
        raise RuntimeError("no source")

    done = refresh.cycle(fails, lambda: refresh.refresh(store, rows, HashedTokens(8)), 5, pauses.append)
    assert done[0] is None and done[1] == store.summary() and pauses == [5]
    with pytest.raises(RuntimeError):
        refresh.cycle(lambda: None, fails, 0, pauses.append)


def test_next_run():
    day = dt.datetime(2024, 5, 1)
    assert refresh.next_run(day.replace(hour=9, minute=15)) == day.replace(hour=12)
    assert refresh.next_run(day.replace(hour=12)) == day.replace(hour=16)
    assert refresh.next_run(day.replace(hour=23, minute=59)) == day + dt.timedelta(days=1)


def test_refresher_starts_and_stops():
    ran = threading.Event()

    def run():
        ran.set()
        raise RuntimeError("logged")

    loop = refresh.Refresher(run, at_once=True, now=lambda: dt.datetime(2024, 5, 1, 9))
    loop.start()
    first = loop._thread
    loop.start()
    assert loop._thread is first and ran.wait(5) and loop.running()
    loop.stop()
    assert not loop.running()


def test_refresher_runs_at_slots():
    ran, just = threading.Event(), dt.datetime(2024, 5, 1, 11, 59, 59, 990000)
    loop = refresh.Refresher(ran.set, now=lambda: just)
    loop.start()
    assert ran.wait(5)
    loop.stop()

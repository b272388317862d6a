import random
import re

import pytest
from pyspark.sql import functions as F
from test_operators import brute_components

from kinmatch.operators.component_store import ComponentStore
from kinmatch.sources.version_log import Conflict, VersionLog
from kinmatch.streaming.probe import component_stream

LINK = "a long, b long"


def found(store, number=None):
    rows = store.read(number).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["component_id"] for r in rows}


def test_batches_give_what_one_run_gives(spark, tmp_path):
    """Chains of merges, loops, nulls, repeated links and an empty batch; the fourth version writes all anew."""
    random.seed(2)
    store = ComponentStore(spark, str(tmp_path / "s"), parts=4, batches=3)
    assert found(store) == {}
    steps = [
        [(50, 51), (60, 61), (7, 7), (None, 3)],
        [(40, 50), (30, 60)],
        [],
        [(40, 30), (51, 50)],
        [(1, 61), (200, 201)],
        [(random.randint(-20, 220), random.randint(-20, 220)) for _ in range(60)],
    ]
    done = []
    for links in steps:
        store.add(spark.createDataFrame(links, LINK), "a", "b")
        done += links
        assert found(store) == brute_components(done)
        assert len(store.log.latest().folders) <= 3
    before = store.log.latest()
    assert store.add(spark.createDataFrame(done, LINK), "a", "b") == before


def test_a_batch_reads_and_writes_what_it_touches(spark, tmp_path):
    store = ComponentStore(spark, str(tmp_path / "s"), parts=64)
    store.add(spark.range(20_000).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 4).alias("b")), "a", "b")
    made = store.add(spark.createDataFrame([(4, 8), (13, 90_000)], LINK), "a", "b")
    written = {k: spark.read.parquet(f"{store.log.path}/{made.folders[-1]}/kind={k}").count() for k in ("nodes", "labels", "members")}
    assert written == {"nodes": 1, "labels": 1, "members": 1}
    asked = store._table("nodes", made, spark.createDataFrame([(4,), (13,)], "node long"))
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ IN", asked._jdf.queryExecution().executedPlan().toString())
    got = found(store)
    assert got[10] == 4 and got[90_000] == 12 and len(got) == 20_001


def test_versions_before_and_two_writers(spark, tmp_path):
    path = str(tmp_path / "s")
    one, two = ComponentStore(spark, path, parts=2), ComponentStore(spark, path, parts=2)
    first = one.add(spark.createDataFrame([(1, 2)], LINK), "a", "b")
    stale = VersionLog(spark, path).latest()
    second = two.add(spark.createDataFrame([(2, 3)], LINK), "a", "b")
    one.log.latest = lambda: stale  # has read before the other one published
    with pytest.raises(Conflict):
        one.add(spark.createDataFrame([(8, 9)], LINK), "a", "b")
    assert found(two) == {1: 1, 2: 1, 3: 1} and found(two, first.number) == {1: 1, 2: 1}
    assert len([s for s in two.log._listed("") if s.getPath().getName().startswith("v=")]) == 2  # the loser's folder is gone
    assert not [s for s in two.log._listed("") if s.getPath().getName().startswith("staged-")]
    assert two.log.retire(1, 3600) == ([], [])
    assert two.log.retire(1, 0) == ([first.number], [])  # its folder is still a part of the current version
    with pytest.raises(KeyError):
        two.read(first.number)
    assert found(two) == {1: 1, 2: 1, 3: 1} and two.log.numbers() == [second.number]
    with pytest.raises(ValueError):
        two.log.retire(0, 0)


def test_folders_that_no_version_names_are_retired(spark, tmp_path):
    store = ComponentStore(spark, str(tmp_path / "s"), parts=2, batches=1)
    for links in ([(1, 2)], [(2, 3)], [(5, 6)]):
        store.add(spark.createDataFrame(links, LINK), "a", "b")
    gone, folders = store.log.retire(1, 0)
    assert gone == [1, 2] and len(folders) == 2
    assert found(store) == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}


def test_links_of_a_stream_over_a_restart(spark, tmp_path):
    store = ComponentStore(spark, str(tmp_path / "s"), parts=2)
    source, state = str(tmp_path / "in"), str(tmp_path / "c")
    steps = [[(5, 6), (8, 9)], [(6, 9)], [(2, 8), (70, 71)]]
    for i, links in enumerate(steps):
        spark.createDataFrame(links, LINK).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LINK).parquet(source)
        component_stream(stream, store, state).awaitTermination()  # each a run of its own, from the checkpoint
        assert found(store) == brute_components(sum(steps[: i + 1], []))

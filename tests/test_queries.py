import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from kinmatch.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return made


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, sf, name):
    df = catalog.queries()[name](spark, sf)
    want = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    places = [want.columns.index(c) for c in columns]
    assert rows == Counter(tuple(plain(r[i]) for i in places) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_spelling_is_mended(spark, sf):
    rows = {r["corrected"] for r in catalog.queries()["spell_correct"](spark, sf).collect()}
    assert all(r.endswith(" 20mm STEEL kgs") for r in rows)
    assert not any("smal " in r for r in rows)


def test_nested_report(spark, sf):
    rows = catalog.queries()["item_duplicate_report_nested"](spark, sf).collect()
    assert {r["group_id"] for r in rows} == {f"DUP_{i + 1}" for i in range(len(rows))}
    assert all(len(r["records"]) > 1 and r["status"]["ITEMDESC"] == "different" for r in rows)


def test_entry_without_training_data_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [["kinmatch/llm"], ["kinmatch/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_imports_where_folders_are_gone(tmp_path, gone):
    """On a copy of the repository without the training-data operators, or the pipeline, or both."""
    home = Path(__file__).resolve().parents[1]
    shutil.copytree(home / "kinmatch", tmp_path / "kinmatch", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (home / name).exists():
            shutil.copy(home / name, tmp_path / name)
    for name in gone:
        there = tmp_path / name
        shutil.rmtree(there, ignore_errors=True) if there.is_dir() else there.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    assert ("'pipeline'" in got.stdout) == (not gone) and all(f"'{q}'" in got.stdout for q in catalog.queries())
    assert ("op5_simhash" in got.stdout) == ("kinmatch/llm" not in gone and (home / "kinmatch/llm").exists())

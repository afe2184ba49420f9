"""Every registered query with SQL against DuckDB, on the smallest tables."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from keelson.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE[name])
    columns = sorted(want.columns)
    assert columns == sorted(df.columns)
    rows = want.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, rows))


def test_window_diff_ties_stand_by_key_as_text(spark, tmp_path):
    """Equal prices lie on both sides of places 20, 50 and 70, with keys of one to three digits."""
    c = duckdb.connect()
    c.sql(f"copy (select range as p_partkey, (900 + range % 3)::double as p_retailprice from range(1, 200)) to '{tmp_path}/part.parquet'")
    c.sql(f"create view part as select * from '{tmp_path}/part.parquet'")
    found = QUERIES["window_diff"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted(c.sql(ORACLE["window_diff"]).fetchall()) and len(found) == 40


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE) <= set(__spark_entry__.oracle_sql())


def test_entry_points_without_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "keelson"):
        if os.path.isdir(f"{root}/{name}"):
            shutil.copytree(f"{root}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(f"{root}/{name}"):
            shutil.copy(f"{root}/{name}", tmp_path / name)
    code = "import __spark_entry__ as e, keelson; print(keelson.__file__, sorted(e.queries()) == sorted(e._core()[0]), len(e.oracle_sql()) > 50)"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(tmp_path / "keelson" / "__init__.py"), "True", "True"]

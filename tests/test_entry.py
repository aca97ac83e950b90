"""Registered queries against their SQL, on the smallest shared tables, and the entry points without the optional parts."""

import glob
import numbers
import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
import __spark_entry__  # noqa: E402
from arbor.plans import registry  # noqa: E402

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no shared tables here")


def rows_of(frame):
    cols = sorted(frame.columns)
    plain = lambda v: None if pd.isna(v) else f"{float(v):.5f}" if isinstance(v, numbers.Number) and not isinstance(v, (bool, np.bool_)) else str(v)
    return sorted(tuple(map(str, map(plain, r))) for r in frame[cols].itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got = registry.queries()[name](spark, DATA).toPandas()
    want = c.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_have_rows(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 1


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_alone(tmp_path):
    for name in os.listdir(ROOT):
        if name not in ("tests", ".git", "corpus_pipeline.py", "arbor"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    (tmp_path / "arbor").mkdir()
    for name in os.listdir(f"{ROOT}/arbor"):
        if name != "llm":
            os.symlink(f"{ROOT}/arbor/{name}", tmp_path / "arbor" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline'], q"
    env = os.environ | {"PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True).returncode == 0

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from wordmill.plans import queries as core

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark".split()
CHECKED = sorted(set(core.oracle_sql()))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    got, want = core.queries()[name](spark, SF_DIR).toPandas(), con.execute(core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_nothing_else_imports_the_llm_subpackage():
    code = "import sys, wordmill.plans.queries, wordmill.streaming.windows; assert not any(m.startswith('wordmill.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)

"""Every registered query with a SQL form equals DuckDB on sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck  # noqa: E402
from tests.conftest import SF_SMALL  # noqa: E402

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    if not os.path.exists(SF_SMALL):
        pytest.skip("test data not available")
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = df.collect()
    res = con.execute(SQL[name])
    ok, msg = compare(rows, df.columns, res.fetchall(), [d[0] for d in res.description])
    assert ok, msg


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 10 and all(0 < r["purity"] <= 1 for r in rows)

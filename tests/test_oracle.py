"""Every registered query beside its SQL, on the smallest data set."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from rolegrid.catalog import ORACLES, QUERIES
from rolegrid.session import TABLES

SF = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("check_oracle", Path(__file__).resolve().parents[1] / "tools" / "check_oracle.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(cols, cur.fetchall())


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_queries_use_no_machine_local_state(spark):
    import __spark_entry__ as e

    assert e.queries().keys() >= e.oracle_sql().keys()
    assert e.entry(spark).count() > 0

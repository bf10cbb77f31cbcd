"""Every named query with SQL, on the smallest tables, against DuckDB."""

import os
import sys
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from check_queries import TABLES, rows_of  # noqa: E402

from tallyspark.plans.catalog import load  # noqa: E402

DIR = "/root/testdata/sf0.001"
NAMES = sorted(load()[1])


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def results(spark):
    """All results, several queries at a time: on tables this small a query mostly waits for its own steps."""
    named = load()[0]

    def run(name):
        df = named[name](spark, DIR)
        return df.columns, df.collect()

    with ThreadPoolExecutor(6) as pool:
        yield {n: pool.submit(run, n) for n in NAMES}


@pytest.mark.parametrize("name", NAMES)
def test_query(results, con, name):
    columns, got = results[name].result()
    cur = con.execute(load()[1][name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(columns)
    assert rows_of(columns, got) == rows_of(names, cur.fetchall())


def test_entry(spark):
    assert entry(spark).count() == 6


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())

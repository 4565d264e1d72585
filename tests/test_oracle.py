"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import SF_SMALL, TABLES, table_hash

from textlens.plans.catalog import QUERIES as OWN

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    from textlens.plans.catalog import ROWS_ONLY

    assert set(OWN) - set(SQL) == ROWS_ONLY


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 7 and "class" in out.columns


@pytest.mark.parametrize("name", sorted(set(SQL) & set(OWN)))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert table_hash(sdf.columns, srows)[0] == table_hash(dcols, drows)[0]

import os

import duckdb
import pytest

from meshweave.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, sf_dir, con, name):
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = [tuple(r) for r in found.select(columns).collect()]
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())

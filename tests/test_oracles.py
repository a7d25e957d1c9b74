"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from lethe.plans import engine_queries, queries

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = {**queries.QUERIES, **engine_queries.QUERIES}, {**queries.ORACLE, **engine_queries.ORACLE}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float) or hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rows = sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=repr)
    want = duck.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    expected = sorted(([plain(r[names.index(c)]) for c in columns] for r in want.fetchall()), key=repr)
    assert rows == expected

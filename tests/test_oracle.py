"""Every query with SQL gives the same rows as DuckDB over the same files."""

import duckdb
import pytest
from conftest import SMALL

from sunloom.workload import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def ordered(columns, rows):
    index = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(r[i] for i in index) for r in rows], key=repr)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None])
def test_matches_oracle(spark, duck, name):
    query = QUERIES[name]
    got = query.run(spark, SMALL)
    want = duck.execute(query.oracle())
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert ordered(got.columns, [tuple(r) for r in got.collect()]) == ordered(columns, want.fetchall())


def test_every_query_has_a_plan(spark):
    for query in QUERIES.values():
        assert query.run(spark, SMALL).columns

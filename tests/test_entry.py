import os

import duckdb
import pytest

import __spark_entry__
from lexiforge.plans import cases, catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries() | cases.queries(), catalog.oracle_sql() | cases.oracle_sql()


def test_entry(spark):
    rows = __spark_entry__.entry(spark).orderBy("rank").collect()
    assert 1 <= len(rows) <= 8 and [r.rank for r in rows] == list(range(1, len(rows) + 1))
    assert all(a.score >= b.score > 0 for a, b in zip(rows, rows[1:]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in "events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == columns
    short = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    mine = sorted((tuple(short(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    theirs = sorted((tuple(short(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    assert mine == theirs

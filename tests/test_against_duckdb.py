"""Every registered query against its independent DuckDB formulation, value by value."""

import math

import duckdb
import pytest

import oracle
from conftest import SF_DIR
from tenderlens import catalog

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
ORACLES = oracle.all_sql()
WITHOUT_SQL: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return repr(value)


def test_every_query_has_a_formulation():
    assert set(catalog.QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, workspace, duck):
    df = catalog.run(name, spark, SF_DIR)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in WITHOUT_SQL:
        assert mine
        return
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in place) for r in cur.fetchall())
    assert mine == theirs

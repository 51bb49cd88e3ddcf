"""The corpus queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from conftest import SF_DIR
from tenderlens.llm import queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(name, spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF_DIR)
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in df.collect())

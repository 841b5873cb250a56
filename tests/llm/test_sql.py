"""Queries that SQL expresses, against DuckDB on the small tables."""

import glob

import duckdb
import pytest

from skein.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        where = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}{'/*.parquet' if glob.glob(f'{where}/*') else ''}'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cur = con.execute(queries.oracle_sql()[name])
    at = [[x[0] for x in cur.description].index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in cur.fetchall())

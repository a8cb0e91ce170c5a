"""Every operator query with SQL gives what DuckDB gives."""

import duckdb
import pytest

from barlight.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = Q.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({Q.oracle_sql()[name]})").fetchall()
    assert plain(map(tuple, df.select(*names).collect())) == plain(want)

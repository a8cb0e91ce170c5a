"""Every query with SQL gives what DuckDB gives."""

import duckdb
import pytest

import __spark_entry__ as entry
from barlight import queries as core

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(rows):
    text = lambda v: "null" if v is None or v != v else repr(round(float(v), 8) + 0.0) if isinstance(v, float) else str(v).removesuffix(" 00:00:00")
    return sorted(tuple(map(text, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_as_sql(spark, tables, name):
    df = core.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    got = plain(map(tuple, df.select(*names).collect()))
    want = plain(tables.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({core.oracle_sql()[name]})").fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

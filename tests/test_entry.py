"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from compare import normal

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
# The text operators have tests of their own.
CORE = {name: query for part in (entry.events, entry.preparation) for name, query in part.QUERIES.items()}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(CORE) <= set(entry.queries())


@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, name):
    df = CORE[name](spark, DATA)
    got = normal(df.collect(), df.columns)
    if sql := entry.oracle_sql().get(name):
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert got == normal(cur.fetchall(), names)

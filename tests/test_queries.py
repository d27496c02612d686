"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
GENERAL = {**entry.general.QUERIES, **entry.catalogue.QUERIES}
SQL = {**entry.general.SQL, **entry.catalogue.SQL}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def bag(rows):
    return Counter(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(GENERAL))
def test_query(spark, duck, name):
    df = GENERAL[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name not in SQL:
        assert columns
        return
    relation = duck.sql(SQL[name])
    assert sorted(relation.columns) == columns
    want = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({SQL[name]})").fetchall()
    assert bag(rows) == bag(want)


def test_names():
    assert set(SQL) <= set(GENERAL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

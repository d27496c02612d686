"""The queries of this subpackage with SQL against DuckDB on the smallest tables; the others must run."""

from collections import Counter
from pathlib import Path

import pytest

from hilite.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({SQL[name]})").fetchall()
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(want) and want


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).columns

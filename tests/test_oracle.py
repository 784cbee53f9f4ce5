"""Every query that has SQL gives the same rows in DuckDB."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
ORACLE = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("p")}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda x: "null" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(text(x) for x in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

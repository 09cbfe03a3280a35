"""Every registered graph query against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from graphloom import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


def plain(rows):
    return sorted(tuple("" if v is None else round(v, 5) if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    found = duck.sql(catalog.oracle_sql()[name])
    assert sorted(found.columns) == cols
    assert plain(df.select(*cols).collect()) == plain(found.select(*cols).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, str(DATA)).count() > 0

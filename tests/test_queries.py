"""Every query of the graph engine against DuckDB on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from weftgraph.plans import registry

DATA = os.environ.get("WEFTGRAPH_TEST_DATA", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int | float):
        return "nan" if math.isnan(v) else round(float(v), 6)
    return [plain(x) for x in v] if isinstance(v, list | tuple) else str(v)


def same(spark_rows, cols, rel):
    names = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(names)
    order = sorted(names)
    a = sorted(str([plain(r[c]) for c in order]) for r in spark_rows)
    b = sorted(str([plain(r[names.index(c)]) for c in order]) for r in rel.fetchall())
    assert len(a) == len(b)
    assert a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in SQL:
        same(rows, df.columns, db.execute(SQL[name]))


def test_flagship_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())

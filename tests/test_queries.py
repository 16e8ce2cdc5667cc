"""Every query with SQL gives the same rows as that SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from lithic.plans import queries
from lithic.plans import kept, records, runs, structure, views  # noqa: F401  register their queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    value = lambda v: None if v is None or v != v else round(float(v), 9) + 0.0 if isinstance(v, int | float) and not isinstance(v, bool) else v
    return sorted(repr(tuple(map(value, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in queries.ORACLES:
        assert got
        return
    found = sql.sql(queries.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert plain(got) == plain(tuple(r[i] for i in at) for r in found.fetchall())

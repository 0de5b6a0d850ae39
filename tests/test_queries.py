"""Every registered core query against its SQL on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

from rallyframe import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    """Rows with their values' types; floats to five digits, as sums differ in their last ones."""
    kept = lambda v: (type(v).__name__, v) if v is None or isinstance(v, (bool, int, str)) else ("float", round(float(v), 5) + 0.0) if isinstance(v, (float, decimal.Decimal)) else ("other", str(v))
    return sorted(repr([kept(v) for v in row]) for row in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, FOLDER)
    want = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    want_rows = want.fetchall()
    assert want_rows
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want_rows)

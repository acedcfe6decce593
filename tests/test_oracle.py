"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
import tessera.plans  # noqa: F401
from tessera.catalogue import ORACLE_SQL, QUERIES


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    try:
        return round(float(v), 6) + 0.0
    except (TypeError, ValueError):
        return str(v)


def _rows(rows, columns):
    order = sorted(columns)
    return sorted((tuple(_plain(v) for v in (dict(zip(columns, r, strict=True))[c] for c in order)) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, data)
    rows = [tuple(r) for r in got.collect()]
    if name not in ORACLE_SQL:
        assert len(got.columns) == len(set(got.columns))
        return
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert _rows(rows, got.columns) == _rows(want.fetchall(), columns)

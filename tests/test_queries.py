"""Registered queries against an independent engine on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from rivulet.plans import flow, relational, scalar, tables  # noqa: F401  the modules register their queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    made.sql("SET TimeZone = 'UTC'")
    for t in tables.TABLES:
        made.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return str(value.replace(tzinfo=None))
    return float(value) if type(value).__name__ == "Decimal" else str(value) if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(tables.QUERIES))
def test_query(spark, db, name):
    got = tables.QUERIES[name](spark, SF)
    if name not in tables.ORACLES:
        assert got.count() > 0
        return
    want = db.sql(tables.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    theirs = sorted((tuple(plain(dict(zip(want.columns, r))[c]) for c in columns) for r in want.fetchall()), key=str)
    assert mine == theirs

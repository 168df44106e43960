import datetime
import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quarry import queries as own

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", list(own.QUERIES))
def test_query(spark, db, name):
    df = own.QUERIES[name](spark, SF)
    found = sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    if name not in own.SQL:
        assert found
        return
    r = db.execute(own.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert found == sorted(repr(tuple(plain(x[i]) for i in order)) for x in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(own.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())

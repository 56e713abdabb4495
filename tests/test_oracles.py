"""Every query with a SQL twin against DuckDB on the smallest data; the rest must run."""

import datetime
import decimal
import math
import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from turnloom import catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.collect("turnloom.plans", catalog.MODULES)
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        return
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=names.__getitem__)
    assert rows == Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)

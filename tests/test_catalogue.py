"""Every registered query with SQL against DuckDB on the smallest tables; the others must run."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from lodestone.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool) or not isinstance(value, (int, float, Decimal)):
        return str(value)
    return round(float(value), 5) + 0.0


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    data = [tuple(r) for r in got.collect()]
    if name not in ORACLES:
        return
    wanted = duck.execute(ORACLES[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, data) == rows(columns, [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in wanted.fetchall()])

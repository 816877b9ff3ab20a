"""Every query against its DuckDB SQL, and that all run."""

from __future__ import annotations

import math
from decimal import Decimal

import pytest

from turnwise import queries as own


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, Decimal):
        return round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query(spark, sf, duck, name):
    df = own.queries()[name](spark, sf)
    rows = df.collect()
    sql = own.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    want = duck.sql(sql)
    columns = [c.lower() for c in want.columns]
    assert sorted(columns) == sorted(c.lower() for c in df.columns)
    names = {c.lower(): c for c in df.columns}
    got = sorted((tuple(plain(r[names[c]]) for c in columns) for r in rows), key=str)
    assert got == sorted((tuple(plain(x) for x in r) for r in want.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and set(e.oracle_sql()) <= set(e.queries())

"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import decimal
import math

import duckdb
import pytest

from quillspark.plans.registry import QUERIES, SQL

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents benchmark".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, float):
        return None if math.isnan(v) else v if math.isinf(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    other = duck.sql(SQL[name])
    assert sorted(other.columns) == cols
    at = [other.columns.index(c) for c in cols]
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in other.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0

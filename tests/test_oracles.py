"""Every registered query with SQL gives the rows that DuckDB gives."""

import pandas as pd
import pytest

import __spark_entry__ as entry
from lexmill.plans import catalogue

from .conftest import SMALL

KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP"}


def plain(v):
    if pd.isna(v):
        return "null"
    return str(int(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) and float(v).is_integer() else str(v)


def rows(frame, columns):
    return sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL)
    want = duck.sql(catalogue.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    types = dict(zip(want.columns, map(str, want.types)))
    assert {c: KINDS[t] for c, t in got.dtypes} == types
    assert rows(got.toPandas(), columns) == rows(want.df(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_callable():
    assert all(map(callable, entry.queries().values()))
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every query with SQL gives the rows that DuckDB gives for it."""

import math
import os
from collections import Counter

import duckdb
import pytest

from noticelake.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    want = db.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_every_query_is_registered_once():
    names = [n for m in registry.MODULES for n in m.QUERIES]
    assert len(names) == len(set(names))
    assert registry.FLAGSHIP in registry.QUERIES

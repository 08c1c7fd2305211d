"""Queries that have SQL give the rows that DuckDB gives for it."""

import duckdb

from noticelake.llm import queries

from .conftest import SF


def test_queries_equal_sql(spark):
    con = duckdb.connect()
    for name in ("conversations", "documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, SF), con.sql(sql)
        order = [got.columns.index(c) for c in want.columns]
        assert sorted(tuple(r[i] for i in order) for r in got.collect()) == sorted(want.fetchall())


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))

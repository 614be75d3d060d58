"""Queries that SQL can express give DuckDB's rows; all queries and the pipeline are registered."""

from __future__ import annotations

import re

import pytest

import __spark_entry__
from frameseg.llm import registry
from tests.test_oracle import DATA, TABLES, rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = registry.queries()[name](spark, DATA).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_registered():
    found = __spark_entry__.queries()
    assert "pipeline" in found
    assert sorted(int(m[1]) for q in found if (m := re.match(r"op(\d+)_", q))) == list(range(1, 11))

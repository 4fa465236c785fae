"""The columns that SQL can express are the same in DuckDB."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from seedlake.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_in_sql(spark, name):
    made = registry.queries()[name](spark, DATA)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    order = sorted(made.columns)
    assert order == sorted(want.columns)
    rows = Counter(tuple(r[c] for c in order) for r in made.collect())
    assert rows == Counter(want.project(", ".join(order)).fetchall())

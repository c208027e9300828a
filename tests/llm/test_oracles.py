"""Queries against their SQL in DuckDB."""

import os

import duckdb
import pytest
from siftline.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    rows = sorted(tuple(r[c] for c in names) for r in got.collect())
    assert rows == sorted(tuple(dict(zip(want.columns, r, strict=True))[c] for c in names) for r in want.fetchall())
    assert rows

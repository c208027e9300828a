"""Every query against the same result in DuckDB, on the small tables."""

import os

import duckdb
import pytest
from siftline.plans.queries import ORACLE, QUERIES

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, want = norm([tuple(r) for r in df.collect()], df.columns), norm(want.fetchall(), want.columns)
    assert len(got) == len(want)
    assert got == want

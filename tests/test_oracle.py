"""Every query that has oracle SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tidebook.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(table, columns):
    out = []
    for r in zip(*(table[c].to_pylist() for c in columns), strict=True):
        out.append(tuple("nan" if isinstance(v, float) and v != v else round(v, 5) + 0.0 if isinstance(v, float) else v for v in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toArrow()
    want = duck.execute(registry.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    a, b = rows(got, sorted(got.column_names)), rows(want, sorted(got.column_names))
    assert len(a) == len(b)
    off = [(x, y) for x, y in zip(a, b, strict=True) if x != y and not all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) < 2e-5 * max(1, abs(p)) for p, q in zip(x, y, strict=True))]
    assert not off, off[:3]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

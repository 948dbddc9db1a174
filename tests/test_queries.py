"""Each query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def shown(rows):
    return sorted((tuple(float(x) if not isinstance(x, str | bool | int | None) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.core.ORACLE_SQL))
def test_query(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF), db.sql(entry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert shown(tuple(r[c] for c in cols) for r in got.collect()) == shown(want.select(*(f'"{c}"' for c in cols)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

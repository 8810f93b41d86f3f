"""Every query that has SQL gives the same rows as DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLE = entry.oracle_sql()


def rows(found, columns):
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 4)
        return str(v) if v is not None else None

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0

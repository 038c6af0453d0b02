"""Every registered query against its expected SQL, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = os.environ.get("SHELFMARK_TEST_SF", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = ordered([tuple(r) for r in df.select(*cols).collect()])
    res = duck.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = ordered([tuple(r[i] for i in at) for r in res.fetchall()])
    assert got == want
    assert got


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns[0] == "product_url" and df.count() > 0

"""Every registered query of the library runs on the smallest tables, and agrees with its SQL."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from recollect.queries import oracle_sql, queries  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, float):
        return f"{v:.5f}"
    return f"{v:.5f}" if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if name in oracle_sql():
        want = duck.sql(oracle_sql()[name])
        assert sorted(want.columns) == sorted(df.columns)
        at = [want.columns.index(c) for c in df.columns]
        assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from tools.check_queries import TABLES, norm  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = sorted(tuple(norm(r[i]) for i in order) for r in rel.fetchall())
    got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(ORACLES) <= set(QUERIES)

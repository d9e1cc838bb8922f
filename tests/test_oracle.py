"""Every SQL-expressible registered query against its DuckDB oracle (sf0.001)."""
import duckdb
import pytest

import __spark_entry__ as E
from eventlens.plans import REGISTRY
from tools.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(dcols, drows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "blindspot_type" in df.columns


def test_every_query_has_oracle_or_is_documented():
    """Of the library's own queries; those of the corpus operators have their tests beside them."""
    assert set(REGISTRY) - set(SQL) <= {"tfidf_embeddings"}

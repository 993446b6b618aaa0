"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from sparkloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(plain(x) for x in value) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((plain(tuple(r[c] for c in columns)) for r in df.collect()), key=repr)
    if name not in catalog.ORACLES:
        assert got
        return
    found = duck.sql(catalog.ORACLES[name])
    at = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert got == sorted((plain(tuple(r[i] for i in at)) for r in found.fetchall()), key=repr)


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())

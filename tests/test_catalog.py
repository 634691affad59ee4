"""Every query with SQL gives the SQL's rows, over the smallest tables."""

import duckdb
import pytest

from factloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_rows(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    found = duck.execute(catalog.oracle_sql()[name])
    at = [[x[0] for x in found.description].index(c) for c in cols]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_every_order_is_resolved(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert catalog.queries()["resolve_every_client"](spark, SF).count() == orders

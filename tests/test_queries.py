import duckdb
import pytest

import __spark_entry__
from keelson.plans import derived, queries

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_like_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    rel = con.execute(queries.SQL[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, rel.fetchall()))


def test_every_query_has_sql_and_rows(spark):
    assert set(queries.QUERIES) == set(queries.SQL)
    assert len(derived.SAMPLES) == len({x[0] for x in derived.SAMPLES}) == 92
    assert queries.QUERIES["scan_samples"](spark, SF).count() == 92 * spark.read.parquet(f"{SF}/supplier.parquet").count()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

import duckdb
import pytest

from keelson.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["bpe_round_trip", "sharding_law", "license_base"])
def test_like_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as from '{SF}/documents.parquet'")
    rel = con.execute(queries.SQL[name])
    names = [d[0] for d in rel.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, rel.fetchall()))


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.QUERIES if n.startswith("op")] == [f"op{k}" for k in range(1, 11)]

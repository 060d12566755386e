import duckdb
import pytest

from freshet.llm import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    rel = con.sql(registry.ORACLES[name])
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(rel.columns)
    assert sorted(df.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(r[i] for i in at) for r in rel.fetchall())
    assert sorted(map(tuple, df.select(cols).collect())) == want

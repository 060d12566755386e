import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from freshet import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "supplier"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def key(row):
    return tuple((0, "") if v is None else (1, round(v, 5)) if isinstance(v, float) else (1, str(v)) if not isinstance(v, (int, bool)) else (1, int(v)) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*(f"`{c}`" for c in cols)).collect()), key=key)
    rel = con.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=key)
    assert len(got) == len(want) > 0
    for g, w in zip(got, want, strict=True):
        for x, y in zip(g, w, strict=True):
            assert (x == y) or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)), (g, w)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert len(catalog.QUERIES[name](spark, SF).collect()) > 0


def test_entry_points(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())

"""Every registered query with SQL against DuckDB on the smallest tables; the others must run."""

import os
from collections import Counter

import duckdb
import pytest

from lodestone.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
QUERIES = registry.all_queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    query, sql = QUERIES[name]
    df = query(spark, SF)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert rows
    if sql:
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert rows == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_search_plans_of_large_keys(spark, duck, tmp_path):
    """The made-up texts don't grow with the keys without end."""
    keys = [1, 4, 5, 1428, 1429, 2860, 5000, 400_000_000, 400_000_001, 400_000_005]
    spark.createDataFrame([(k,) for k in keys], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    query, sql = QUERIES["search_plans"]
    df = query(spark, str(tmp_path))
    want = duck.execute(f"WITH part AS (SELECT unnest({keys})::bigint AS p_partkey) {sql}").fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(want)

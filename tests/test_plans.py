"""Every plan against its SQL, run by DuckDB on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from graphloom.operators import traverse
from graphloom.plans import registry

DIR = "/root/testdata/sf0.001"


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted([tuple(str(x) if not isinstance(x, float) else round(x, 6) for x in r) for r in df.itertuples(index=False)], key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, DIR).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want) and len(got)


def test_pagerank_star(spark):
    edges = spark.createDataFrame([(i, 9, 1) for i in range(1, 5)], "src long, dst long, weight long")
    rank = {r["id"]: r["rank"] for r in traverse.pagerank(edges).collect()}
    assert rank[9] == pytest.approx(0.523809, abs=1e-5) and rank[1] == pytest.approx(0.119048, abs=1e-5)

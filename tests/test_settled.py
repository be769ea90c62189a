"""Communities go on until labels settle, however many rounds that takes."""

import os

import duckdb
import pandas as pd

from graphloom.operators import graphs
from graphloom.plans import wide

#: Nations 10 to 24 buy from the nation before, of ten suppliers each; the first buys much from itself.
FIRST, LAST = 10, 24


def test_labels_reach_the_end_of_a_chain(spark, tmp_path):
    nations = range(FIRST, LAST + 1)
    orders = [(100 * k, k) for k in nations] + [(100 * FIRST + i, FIRST) for i in range(1, 20)]
    lines = [(100 * k, 100 * (k - 1) + j) for k in nations if k > FIRST for j in range(10)]
    suppliers = [100 * k + j for k in nations for j in range(10)]
    tables = {
        "region": {"r_regionkey": [0], "r_name": ["R"]},
        "nation": {"n_nationkey": list(nations), "n_name": [f"N{k}" for k in nations], "n_regionkey": [0] * len(nations)},
        "customer": {"c_custkey": list(nations), "c_name": [f"C{k}" for k in nations], "c_nationkey": list(nations), "c_mktsegment": ["A"] * len(nations)},
        "supplier": {"s_suppkey": suppliers, "s_name": [f"S{k}" for k in suppliers], "s_nationkey": [k // 100 for k in suppliers]},
        "part": {"p_partkey": [1], "p_name": ["P"], "p_brand": ["B#1"]},
        "orders": {"o_orderkey": [o for o, _ in orders], "o_custkey": [c for _, c in orders]},
        "lineitem": {"l_orderkey": [o for o, _ in lines], "l_partkey": [2] * len(lines), "l_suppkey": [s for _, s in lines], "l_quantity": [1] * len(lines)},
    }
    con = duckdb.connect()
    for name, cols in tables.items():
        pd.DataFrame(cols).to_parquet(os.path.join(tmp_path, f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = {r["id"]: r["label"] for r in wide.QUERIES["communities"](spark, str(tmp_path)).collect()}
    assert {got[f"r0/n{k}"] for k in nations} == {f"r0/n{FIRST}"}
    assert got == dict(con.execute(wide.ORACLES["communities"]).fetchall())


def test_states_that_alternate(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b", 5)], "src string, dst string, weight long")
    labels = lambda **how: {r["id"]: r["label"] for r in graphs.communities(nodes, edges, **how).collect()}
    assert labels() == labels(rounds=1000) == {"a": "a", "b": "b"}
    assert labels(rounds=1) == labels(rounds=1001) == {"a": "b", "b": "a"}

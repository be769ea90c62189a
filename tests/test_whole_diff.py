"""The snapshot difference covers every kind of edge and keeps multi-edges."""

from collections import Counter

import pandas as pd

from graphloom.plans import registry


def test_all_kinds_and_multi_edges(spark, tmp_path):
    tables = {
        "lineitem": {"l_orderkey": [7, 7, 11, 11, 77, 1], "l_partkey": [5, 5, 6, 8, 5, 5], "l_suppkey": [3, 3, 3, 4, 3, 3]},
        "orders": {"o_orderkey": [7, 11, 77, 1], "o_custkey": [3, 3, 3, 3]},
        "customer": {"c_custkey": [3], "c_nationkey": [1]},
        "supplier": {"s_suppkey": [3, 4], "s_nationkey": [1, 1]},
    }
    for name, cols in tables.items():
        pd.DataFrame(cols).to_parquet(tmp_path / f"{name}.parquet")
    got = Counter((r["change"], r["kind"], r["src"] % 10**10, r["dst"] % 10**10) for r in registry.QUERIES["edge_diff_whole"](spark, str(tmp_path)).collect())
    assert got == {
        ("added", "Calls", 7, 5): 2,
        ("added", "References", 7, 3): 1,
        ("added", "Instantiates", 3, 7): 1,
        ("removed", "Calls", 11, 6): 1,
        ("removed", "Calls", 11, 8): 1,
        ("removed", "References", 11, 3): 1,
        ("removed", "References", 11, 4): 1,
        ("removed", "Instantiates", 3, 11): 1,
    }

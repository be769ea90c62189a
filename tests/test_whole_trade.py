"""Components and ranks cover every sale, also those after order 40."""

import pandas as pd
import pytest

from graphloom.plans import registry

#: Buyer and seller of the sales: orders 1 and 2 form a chain, order 41 closes it, order 50 adds nation 4.
SALES = [(1, 1, 2), (2, 2, 3), (41, 3, 1), (50, 4, 1), (51, 2, 2)]


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("trade")
    tables = {
        "lineitem": {"l_orderkey": [o for o, _, _ in SALES], "l_suppkey": [s for _, _, s in SALES]},
        "orders": {"o_orderkey": [o for o, _, _ in SALES], "o_custkey": [c for _, c, _ in SALES]},
        "customer": {"c_custkey": [1, 2, 3, 4], "c_nationkey": [1, 2, 3, 4]},
        "supplier": {"s_suppkey": [1, 2, 3], "s_nationkey": [1, 2, 3]},
    }
    for name, cols in tables.items():
        pd.DataFrame(cols).to_parquet(d / f"{name}.parquet")
    return str(d)


def test_components_of_all_sales(spark, sf_dir):
    got = {tuple(r) for r in registry.QUERIES["strong_components_whole"](spark, sf_dir).collect()}
    assert got == {(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 1)}


def test_ranks_of_all_sales(spark, sf_dir):
    rank = {r["id"]: r["rank"] for r in registry.QUERIES["pagerank"](spark, sf_dir).collect()}
    assert set(rank) == {1, 2, 3, 4} and sum(rank.values()) == pytest.approx(1)
    assert rank[4] == pytest.approx(0.15 / 4, abs=1e-6)
    assert rank[1] == pytest.approx(0.15 / 4 + 0.85 * (rank[3] + rank[4]), abs=1e-5)

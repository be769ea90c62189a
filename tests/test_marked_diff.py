"""Snapshots told by conditions give the changes of two edge tables, without hashes of keys beside edges."""

import random

from pyspark.sql import functions as F

from graphloom.operators import compare
from graphloom.plans import wide


def test_equal_to_two_tables(spark):
    rng = random.Random(5)
    # keys and ids repeat, some ends are no nodes, one kind and many labels are null
    nodes = [(rng.randrange(30), "Function", f"q{rng.randrange(12)}", rng.choice(["f", None])) for _ in range(40)]
    edges = [(rng.choice(["Calls", "Imports", None]), rng.randrange(33), rng.randrange(33), rng.choice([None, None, "x"]), rng.choice([True, False, True, None]), rng.choice([True, False])) for _ in range(500)]
    nodes = spark.createDataFrame(nodes, "id long, kind string, qualified_name string, file string")
    edges = spark.createDataFrame(edges, "kind string, src long, dst long, label string, o boolean, n boolean")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = rows(compare.edge_diff(nodes, edges.where("o"), nodes, edges.where("n")))
    got = rows(compare.marked_diff(nodes, edges, F.col("o"), F.col("n")))
    assert got == want and {r[0] for r in got} == {"added", "removed"} and {r[4] for r in got} == {None, "x"}


def test_no_change(spark):
    nodes = spark.createDataFrame([(1, "q"), (2, "r")], "id long, qualified_name string")
    edges = spark.createDataFrame([("Calls", 1, 2)], "kind string, src long, dst long")
    assert compare.marked_diff(nodes, edges, F.lit(True), F.lit(True)).isEmpty()


def test_edges_go_without_hashes(spark):
    plan = wide.QUERIES["edge_diff_semantic"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in plan and plan.count("Exchange hashpartitioning") <= 1

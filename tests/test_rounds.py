"""Tables of rounds go with the round that supersedes them; parents of a neighbourhood; source text in what explore gives."""

import glob

from pyspark.sql import functions as F

from graphloom.operators import graphs, intel
from graphloom.operators import traverse as tr
from graphloom.sources.tables import Scope, shared_dir


def tables(spark):
    return set(glob.glob(f"{shared_dir(spark).removeprefix('file:').replace('//', '/')}/graphloom-round-*"))


def ring(spark, n):
    return spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), F.lit(1).cast("long").alias("weight"))


def test_tables_do_not_pile_up(spark):
    before = tables(spark)
    edges = ring(spark, 6).union(spark.createDataFrame([(10, 0, 1)], "src long, dst long, weight long"))
    ranks = tr.pagerank(edges, rounds=8, tolerance=0.0)
    assert len(tables(spark) - before) == 1
    total = ranks.agg(F.sum("rank")).first()[0]
    assert ranks.count() == 7 and abs(total - 1) < 1e-9

    before = tables(spark)
    found = tr.strong_components(edges)
    left = len(tables(spark) - before)
    assert {(r["id"], r["component_id"], r["size"]) for r in found.collect()} == {(i, 0, 6) for i in range(6)} | {(10, 10, 1)}
    assert left <= 2  # the members found in every outer round

    before = tables(spark)
    nodes = spark.range(6).select("id")
    labels = graphs.communities(nodes, ring(spark, 6))
    assert len(tables(spark) - before) == 1 and labels.count() == 6


def test_rows_are_the_same_inside_a_scope(spark):
    plain = sorted(map(tuple, tr.pagerank(ring(spark, 5), rounds=4, tolerance=0.0).collect()))
    before = tables(spark)
    with Scope(spark) as scope:
        ranks = tr.pagerank(ring(spark, 5), rounds=4, tolerance=0.0)
    assert tables(spark) == before
    assert sorted(map(tuple, ranks.collect())) == plain
    scope.drop()


NODES = "id long, kind string, name string, qualified_name string, file string, location struct<file string, start_line int, start_col int, end_line int, end_col int>"


def test_parent_and_source(spark):
    rows = [
        (1, "File", "a.rs", "a.rs", "a.rs", ("a.rs", 1, 1, 1, 1)),
        (-5, "Module", "m", "m", "a.rs", ("a.rs", 1, 1, 4, 2)),
        (-2, "Class", "C", "m::C", "a.rs", ("a.rs", 2, 1, 4, 2)),
        (7, "Method", "run", "m::C::run", "a.rs", ("a.rs", 2, 3, 3, 4)),
        (8, "Function", "alone", "alone", "gone.rs", ("gone.rs", 1, 1, 2, 2)),
    ]
    nodes = spark.createDataFrame(rows, NODES)
    edges = spark.createDataFrame([("Contains", 1, 7), ("Contains", -5, 7), ("Contains", -2, 7), ("Contains", 99, 8)], "kind string, src long, dst long")
    got = {(r["role"], r["id"]) for r in intel.neighbourhood(nodes, edges, 7).collect()}
    assert got == {("container", -2), ("parent", -5)}  # -2 is the largest number without a sign
    assert intel.neighbourhood(nodes, edges, 8).isEmpty()  # what contains it is no node

    files = spark.createDataFrame([("a.rs", "mod m {\n  fn run() {\n  é}\n}\n"), ("b.rs", "x")], "path string, content string")
    part = lambda term: [tuple(r) for r in intel.explore(nodes, edges, term, files=files).where("section = 'source'").collect()]
    assert part("run") == [("source", "m::C::run", "fn run() {\n  ")]  # a cut inside a letter moves back
    assert part("alone") == [] and part("nothing") == []
    assert intel.explore(nodes, edges, "run").where("section = 'source'").isEmpty()
    assert "      fn run() {" in intel.markdown(intel.explore(nodes, edges, "run", files=files), "run")

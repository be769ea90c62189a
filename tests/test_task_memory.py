"""Plans that hold in a task what grows with groups, not with all edges; and their results."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graphs, intel, queries
from graphloom.sources import tables

from test_wide import DIR, NODES


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("first", ["context", "intel", "export", "compare"])
def test_modules_load_in_any_order(first):
    code = f"import sys; sys.path.insert(0, '.'); import graphloom.operators.{first}; import graphloom.graph"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0


def some_graph(spark):
    nodes = spark.createDataFrame([(i, "Function", f"f{i}", f"f{i}", f"m{i % 2}/a.rs") for i in range(4)], NODES)
    edges = spark.createDataFrame([("Calls", 0, 1), ("Calls", 0, 1), ("Imports", 2, 3), ("Zigzag", 0, 3), ("Aside", 2, 1), ("Implements", 1, 1), ("Contains", 3, 0)], "kind string, src long, dst long")
    return nodes, edges


def test_projection_keeps_kinds_and_sorts_no_edges(spark):
    nodes, edges = some_graph(spark)
    got = {(r["src"], r["dst"]): (r["weight"], r["kinds"]) for r in graphs.projected(nodes, edges, "module")[1].collect()}
    assert got == {("m0", "m1"): (5, "Aside,Zigzag,Imports,Calls"), ("m1", "m1"): (1, "Implements")}
    plan = planned(graphs.projected(tables.whole_nodes(spark, DIR), tables.whole_edges(spark, DIR), "module")[1])
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "ShuffledHashJoin" in plan
    assert {(r["src"], r["kinds"]) for r in queries.project(nodes, edges, "module")[1].collect()} == {("m0", "Aside,Calls,Imports,Zigzag"), ("m1", "Contains"), ("m1", "Implements")}


def test_links_of_customers_are_made_by_all_partitions(spark):
    links = tables.edges(spark, DIR).where("kind = 'Implements'")
    assert links.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_parent_is_the_least_unsigned_number_without_a_sort(spark):
    nodes, edges = some_graph(spark)
    more = edges.union(spark.createDataFrame([("Contains", -5, 0), ("Contains", 7, 0), ("Contains", -9, 1)], edges.schema))
    found = intel.explained(nodes, more)
    assert {r["id"]: r["parent"] for r in found.collect()} == {0: 3, 1: -9, 2: None, 3: None}
    assert "SortAggregate" not in planned(found)


def test_unreferenced_nodes_are_not_sorted(spark):
    nodes, edges = some_graph(spark)
    found = queries.unreferenced(nodes, edges)
    assert [r["id"] for r in found.orderBy("id").collect()] == [0, 2]
    assert "SortMergeJoin" not in planned(found)


def test_resolution_broadcasts_no_table(spark):
    from graphloom.operators import build, resolve
    from graphloom.plans import resolution

    files, records, nodes = resolution._graph(spark, DIR)
    targets, refs = tables.cut(build.import_targets(files, records)), tables.cut(build.references(records))
    found = build.edges_of(files, records, nodes, resolve.resolved(refs, nodes, targets, resolve.reexports(targets, nodes)), targets)
    assert "BroadcastHashJoin" not in planned(found)


def test_files_of_too_few_commits_make_no_pairs(spark):
    from graphloom.operators import compare

    rows = [(k, f) for k in range(10) for f in ("a", "b") if k < 5 or f == "a"] + [(k, f"once{k}") for k in range(10)]
    commits = spark.createDataFrame(rows, "commit long, file string")
    n, total = commits.groupBy("file").agg(F.count("*").alias("n")), commits.agg(F.count_distinct("commit").alias("total"))
    assert {r["file"] for r in compare.often(n, total, 0.5).collect()} == {"a", "b"}
    assert [(r["file_a"], r["file_b"], r["co_commits"], r["commits_a"]) for r in compare.co_change(commits, 0.5).collect()] == [("a", "b", 5, 10)]
    assert [(r["file_a"], r["file_b"], r["co_commits"], r["conf_a_b"]) for r in queries.change_coupling(commits, 0.5).collect()] == [("a", "b", 5, 0.5)]
    assert queries.change_coupling(commits, 0.6).count() == 0


def test_slices_split_no_further_than_the_span(spark):
    from graphloom.operators import context

    files = spark.createDataFrame([("a", "eins\r\nzwei\ndé\n\nfünf\n"), ("e", ""), ("n", None)], "path string, content string")
    ends = [("a", 1, 1, 2, 1), ("a", 2, 3, 3, 3), ("a", 5, 1, 9, 1), ("a", 4, 1, 4, 1), ("a", 8, 1, 9, 1), ("a", 0, 1, 2, 1), ("a", 3, 1, 2, 1), ("a", 1, 1, 1, 3), ("e", 1, 1, 1, 1), ("n", 1, 1, 3, 1), ("a", -3, 1, -2, 1), ("a", 5, 1, 2**31 - 1, 1)]
    spans = spark.createDataFrame([(i, *x) for i, x in enumerate(ends)], "id long, file string, start_line int, start_col int, end_line int, end_col int")
    got = context.slices(spans, files)
    assert [r["text"] for r in got.orderBy("id").collect()] == ["eins\nzwei", "ei\nd", "fünf\n", "", "", "", "", "ei", "", "", "", "fünf\n"]
    assert "end_line" in planned(got).split("split(")[1].split(") AS")[0]


def test_keys_of_ends_are_bytes(spark):
    from graphloom.operators import compare

    nodes, edges = some_graph(spark)
    assert {len(r["src_key"]) for r in compare.semantic_edges(nodes, edges).collect()} == {32}
    assert sorted((r["change"], r["kind"], r["src"]) for r in compare.edge_diff(nodes, edges, nodes, edges.where("kind <> 'Calls'")).collect()) == [("removed", "Calls", 0)] * 2

"""Steps from a few nodes make only the edges that meet them, with the rows of the join."""

from graphloom.operators import graphs
from graphloom.operators import traverse as tr
from graphloom.sources import tables as src

DIR = "/root/testdata/sf0.001"


def test_a_small_front_is_a_condition_on_the_tables(spark, monkeypatch):
    edges, front = src.whole_edges(spark, DIR), spark.createDataFrame([(5 * src.SPAN + 1,)], "id long")
    near = tr.among(edges, "dst", front)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert f"= {5 * src.SPAN + 1}" in plan and not plan.lstrip().startswith("Filter")  # below the union
    assert near.count() == edges.where(f"dst = {5 * src.SPAN + 1}").count() > 0
    monkeypatch.setattr(tr, "FEW", 0)
    assert tr.among(edges, "dst", front) is edges
    assert tr.among(edges, "dst", front.limit(0)).count() == 0


def test_impact_is_the_same_from_conditions_and_joins(spark, monkeypatch):
    nodes = spark.createDataFrame([(i, "Function", f"f{i}", f"q{i}", "a.rs") for i in range(6)], "id long, kind string, name string, qualified_name string, file string")
    edges = spark.createDataFrame([("Calls", 1, 0), ("References", 2, 0), ("Calls", 3, 1), ("Imports", 3, 2), ("Calls", 0, 3), ("Contains", 5, 0), ("Calls", 4, 3), ("Calls", 9, 0)], "kind string, src long, dst long")
    work = lambda: (sorted(graphs.impact(nodes, edges, 0).collect()), sorted(tr.levels(edges, nodes.where("id = 0").select("id"), 3, reverse=True).collect()))
    asked, joined = [], tr.among
    monkeypatch.setattr(graphs, "among", lambda rows, column, front: asked.append(column) or joined(rows, column, front))
    few = work()
    assert asked.count("dst") == 3 and [(r["id"], r["depth"]) for r in few[0]] == [(1, 1), (2, 1), (3, 2), (4, 3)]
    monkeypatch.setattr(tr, "FEW", 0)
    assert work() == few

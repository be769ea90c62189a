"""Value flow from source text to paths between variables."""

from pyspark.sql import functions as F

from graphloom.graph import CodeGraph
from graphloom.operators import compare
from graphloom.sources import flow

APP = "def read(name):\n    data = name\n    return data\n\ndef clean(x):\n    y = x\n    if y:\n        z = y\n    return z\n\ndef main(arg):\n    got = read(arg)\n    done = clean(got)\n    send(done)\n\ndef send(payload):\n    out = payload\n"


def test_rows():
    rows = flow.python_flow("a.py", APP)
    assert ("a.py", "clean", "assignment", "z", "y", None, None, None, 1, 8) in rows
    assert {(r[1], r[3], r[7]) for r in rows if r[2] == "parameter"} == {("read", "name", 0), ("clean", "x", 0), ("main", "arg", 0), ("send", "payload", 0)}
    assert flow.python_flow("a.py", "def broken(") == []
    go = flow.lexical_flow("a.go", "go", "package p\nfunc f(a int) int {\n  b := a\n  c := g(b)\n  return c\n}\n")
    assert {("assignment", "b", "a"), ("return", "c", None), ("call", "c", None)} <= {(r[2], r[3], r[4]) for r in go}
    assert [(r[3], r[7]) for r in go if r[2] == "argument"] == [("b", 0)]


def test_paths(spark):
    sources = spark.createDataFrame([("a.py", "python", APP)], "path string, language string, text string")
    g = CodeGraph.from_sources(sources)
    edges = flow.flow_edges(flow.local_flow(sources), g.nodes, g.edges)
    ids = {r["name"]: r["id"] for r in g.nodes.where("kind = 'Function'").collect()}
    one = lambda f, v: spark.createDataFrame([(f"{ids[f]}:{v}",)], "id string")
    got = compare.flow_paths(edges, one("main", "arg"), one("send", "out")).select(F.regexp_replace("path", r"-?\d+:", "").alias("path"), "confidence").collect()
    paths = [tuple(r) for r in got]
    assert ("arg -> name -> data -> got -> x -> y -> z -> done -> payload -> out", "Inferred") in paths
    assert ("arg -> got -> done -> payload -> out", "Resolved") in paths  # an assignment also takes what its call is given

"""Wide graph queries against their SQL, and operators on small graphs with known results."""

import glob
import hashlib
import os
import xml.dom.minidom

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.functions import schema as S
from graphloom.operators import compare, context, export, graphs, intel, queries
from graphloom.operators import traverse as tr
from graphloom.plans import wide

from test_plans import plain

DIR = "/root/testdata/sf0.001"
NODES = "id long, kind string, name string, qualified_name string, file string"


@pytest.mark.parametrize("name", sorted(wide.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(wide.ORACLES[name]).df()
    got = wide.QUERIES[name](spark, DIR).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def graph(spark, names, links, kind="Calls"):
    nodes = [(i, "Function", n.rpartition("/")[2].split(".")[0], n, n) for i, n in enumerate(names)]
    edges = [(k if len(e) > 2 else kind, e[0], e[1]) for e in links for k in [e[2] if len(e) > 2 else kind]]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, "kind string, src long, dst long")


def p_graph(spark, edges):
    names = sorted({x for e in edges for x in e[:2]})
    return spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame([(*e[:2], e[2] if len(e) > 2 else 1) for e in edges], "src string, dst string, weight long")


def components(p_nodes, p_edges):
    return graphs.component_ids(wide._components(p_nodes, p_edges), p_edges)


def test_components_and_cycles(spark):
    p_nodes, p_edges = p_graph(spark, [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("e", "e")])
    comp = components(p_nodes, p_edges)
    assert {(r["id"], r["number"], r["trivial"]) for r in comp.collect()} == {("a", 0, False), ("b", 0, False), ("c", 1, False), ("d", 1, False), ("e", 2, False)}
    assert [tuple(r) for r in graphs.cycles(p_edges, comp).collect()] == [("a -> b", 2), ("c -> d", 2)]
    assert [r["path"] for r in graphs.cycles(p_edges, comp, self_loops=True).collect()] == ["e", "a -> b", "c -> d"]
    triangle = p_graph(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    assert [tuple(r) for r in graphs.cycles(triangle[1], components(*triangle)).collect()] == [("a -> b -> c", 3)]
    chain = p_graph(spark, [("a", "b"), ("b", "c")])
    assert graphs.cycles(chain[1], components(*chain)).count() == 0


def test_hotspot_scores(spark):
    p_nodes, p_edges = p_graph(spark, [("CoreA", "CoreB"), ("CoreB", "CoreA"), ("Caller1", "CoreA"), ("Caller2", "CoreA"), ("CoreA", "Leaf")])
    got = {r["id"]: round(r["score"], 4) for r in graphs.hotspots(p_nodes, p_edges, tr.pagerank(p_edges), components(p_nodes, p_edges)).collect()}
    assert got == pytest.approx({"CoreA": 66.5241, "CoreB": 17.1058, "Leaf": 6.7081, "Caller1": 1.7002, "Caller2": 1.7002}, abs=2e-3)


def test_communities(spark):
    p_nodes, p_edges = p_graph(spark, [("0", "1"), ("1", "2"), ("2", "0"), ("3", "4"), ("4", "5"), ("5", "3"), ("2", "3")])
    assert {r["id"]: r["label"] for r in graphs.communities(p_nodes, p_edges).collect()} == {"0": "0", "1": "0", "2": "0", "3": "3", "4": "3", "5": "3"}
    pair = p_graph(spark, [("a", "b")])
    for n in (1, 2, 3):
        assert {r["label"] for r in graphs.communities(*pair, rounds=n).collect()} == {"a"}


def test_weighted_pagerank(spark):
    _, e = p_graph(spark, [("a", "b", 1), ("a", "c", 3)])
    rank = {r["id"]: r["rank"] for r in tr.pagerank(e).collect()}
    assert [rank[x] for x in "abc"] == pytest.approx([0.259740, 0.314935, 0.425325], abs=1e-5)


def test_shortest_path(spark):
    edges = spark.createDataFrame([(0, "Calls", 1, 2), (1, "Calls", 2, 1), (2, "Calls", 2, 3)], "id long, kind string, src long, dst long")
    assert [r["edge_id"] for r in graphs.shortest_path(edges, 1, 3, 10).collect()] == [0, 2]
    assert graphs.shortest_path(edges, 1, 3, 1).count() == 0
    assert graphs.shortest_path(edges, 1, 1).count() == 0
    with pytest.raises(ValueError):
        graphs.shortest_path(edges, 1, 3, 10, max_visited=1)


def test_impact(spark):
    n, e = graph(spark, ["src/leaf.rs", "src/mid.rs", "src/root.rs", "tests/test_mid.rs"], [(1, 0), (2, 1), (3, 1)])
    hit = graphs.impact(n, e, 0, 3)
    got = {r["id"]: (r["depth"], r["impact"], r["path"]) for r in hit.collect()}
    assert got[1] == (1, "Direct", "src/leaf.rs > src/mid.rs") and got[2][:2] == (2, "Transitive") and got[3][:2] == (2, "Transitive")
    c = graphs.impact_counts(hit).first()
    assert (c["total"], c["direct"], c["transitive"], c["possible"], c["test_files"]) == (3, 1, 2, 0, 1)


def test_lookup_and_explain(spark):
    n = spark.createDataFrame([(10, "Function", "shared", "shared", "a.rs"), (20, "Function", "other", "shared", "b.rs"), (30, "Function", "shared", "other.rs", "c.rs")], NODES)
    find = lambda t: sorted(r["id"] for r in queries.find(n, t).collect())
    assert (find("shared"), find("missing"), find("har"), find("")) == ([10, 20, 30], [], [10, 20, 30], [])
    n, e = graph(spark, list("abcdefg"), [(1, 2, "Contains"), (6, 2, "Contains"), (3, 2), (2, 4), (2, 5, "Imports")])
    r = intel.explained(n, e).where("id = 2").first()
    assert (r["parent"], r["incoming"], r["outgoing"], r["callers"], r["callees"], r["imports"]) == (1, 3, 2, 1, 1, 1)


def test_neighbourhood_and_tests(spark):
    rows = [(1, "File", "lib.rs", "src/lib.rs", "src/lib.rs"), (2, "Function", "handle", "src/lib.rs::handle", "src/lib.rs"), (3, "Function", "main", "src/main.rs::main", "src/main.rs"), (4, "Function", "test_handle", "tests/lib_test.rs::test_handle", "tests/lib_test.rs"), (5, "Function", "save", "src/db.rs::save", "src/db.rs"), (6, "Trait", "Handler", "src/lib.rs::Handler", "src/lib.rs"), (7, "File", "lib_test.rs", "tests/lib_test.rs", "tests/lib_test.rs")]
    n = spark.createDataFrame(rows, NODES)
    e = spark.createDataFrame([("Contains", 1, 2), ("Calls", 3, 2), ("Calls", 4, 2), ("Calls", 2, 5), ("Implements", 2, 6)], "kind string, src long, dst long")
    got: dict[str, set] = {}
    for r in intel.neighbourhood(n, e, 2).collect():
        got.setdefault(r["role"], set()).add(r["id"])
    assert got == {"container": {1}, "parent": {1}, "caller": {3, 4}, "callee": {5}, "implementation": {6}, "test": {4}}
    tests = {(r["source_file"], r["source_symbol"], r["test_file"], r["test_symbol"]) for r in intel.discovered_tests(n, e).collect()}
    assert tests == {("src/lib.rs", "src/lib.rs::handle", "tests/lib_test.rs", "tests/lib_test.rs::test_handle"), ("src/lib.rs", None, "tests/lib_test.rs", None)}
    assert {tuple(r) for r in intel.tests_of(intel.discovered_tests(n, e), "handle").collect()} == {("tests/lib_test.rs", "tests/lib_test.rs::test_handle")}
    assert {(r["id"], r["entry"]) for r in intel.entrypoints(n).collect()} == {(3, "MainFunction")}
    assert "## caller" in intel.markdown(intel.explore(n, e, "handle"), "handle")
    roles = {r["id"]: (r["role"], r["distance"]) for r in context.expanded(n, e, n.where("id = 2").select("id"), 2).collect()}
    assert roles == {2: ("Seed", 0), 4: ("Test", 1), 7: ("Test", 1), 1: ("Container", 1), 5: ("Callee", 1), 3: ("Caller", 1), 6: ("Implementation", 1)}
    score = {r["id"]: r["score"] for r in context.ranked(context.expanded(n, e, n.where("id = 2").select("id"), 2), n).collect()}
    assert (score[2], score[5], score[3], score[1], score[6], score[4]) == (1000, 800, 800, 750, 650, 200)


def test_layers(spark):
    layers = [("domain", ["domain", "src/model/**"], []), ("app", ["cli"], ["domain"])]
    n, e = graph(spark, ["src/model/domain.rs", "src/cli/app.rs", "src/domainish.rs"], [(0, 1), (1, 0), (2, 1)])
    r = compare.layer_report(n, e, layers).first()
    assert (r["violations_count"], r["passed"], r["total_edges_evaluated"]) == (1, False, 2)
    assert compare.layer_report(*graph(spark, ["src/domainish.rs", "x/y.rs"], [(0, 1)]), layers).first()["passed"]
    match = lambda p, path: spark.range(1).select(compare.layer_of(F.lit(path), [("l", [p], [])])).first()[0] == "l"
    assert match("model", "a/mymodel/b.rs") and not match("model", "a/modelx/b.rs") and match("mod*", "a/xmodel/b.rs") and match("a/*.rs", "a/b.rs") and not match("a/b", "a/b/c.rs")


def test_history(spark):
    commits = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "a"), ("c2", "b"), ("c2", "c"), ("c3", "a")], "commit string, file string")
    for block in (64, 1):
        r = compare.co_change(commits, 0.1, block).where("file_a = 'a' AND file_b = 'b'").first()
        assert (r["co_commits"], r["commits_a"], r["commits_b"], r["conf_b_a"]) == (2, 3, 2, 1.0) and r["support"] == pytest.approx(2 / 3, abs=1e-6)


def test_budget_and_bundle(spark):
    items = spark.createDataFrame([(i, 10 + i, c) for i, c in enumerate([6, 5, 3, 2])], "rank long, id long, cost long")
    assert [r["cost"] for r in context.allocated(items, 10).where("included").orderBy("rank").collect()] == [6, 3]
    assert [r["cost"] for r in context.allocated(items, 1).where("included").collect()] == [6]
    spans = spark.createDataFrame([("f", 1, 10, 1, 4), ("f", 2, 5, 2, 4), ("f", 8, 12, 3, 4), ("f", 9, 12, 4, 4)], "file string, start_line int, end_line int, id long, tokens long")
    assert sorted((r["start_line"], r["end_line"], r["file_slices"], r["file_tokens"]) for r in context.bundled(spans).collect()) == [(1, 10, 2, 8), (8, 12, 2, 8)]


def test_slices(spark):
    files = spark.createDataFrame([("a", "prefix café suffix"), ("b", "éclair"), ("c", "one\ntwo\nthree")], "path string, content string")
    spans = spark.createDataFrame([(1, "a", 1, 8, 1, 13), (2, "b", 1, 2, 1, 8), (3, "c", 1, 1, 2, 1), (4, "x", 1, 1, 1, 1), (5, "c", 2, 2, 3, 3)], "id long, file string, start_line int, start_col int, end_line int, end_col int")
    assert {r["id"]: r["text"] for r in context.slices(spans, files).collect()} == {1: "café", 2: "clair", 3: "one\ntwo", 4: "", 5: "wo\nth"}


def test_identifiers(spark):
    df = spark.createDataFrame([("rust", "x/repo/a\\b.rs", "Function", "a::f", None, "(x)"), (None, "b", "File", "b", "c", None)], "language string, file string, kind string, q string, container string, signature string")
    got = [r[0] for r in df.select(S.node_id(*(F.col(c) for c in ("language", "file", "kind", "q", "container", "signature")))).collect()]
    number = lambda seed: int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "little", signed=True)
    assert got == [number("node\x001\x00a/b.rs\x005\x00a::f\x00\x00(x)"), number("node\x000\x00b\x001\x00b\x00c\x00")]
    e = spark.createDataFrame([(-1, 5, "Calls", "Resolved", None), (1, 2, "Contains", "Extracted", "l")], "a long, b long, k string, c string, l string")
    got = [r[0] for r in e.select(S.edge_id(*(F.col(c) for c in "abkcl"))).collect()]
    assert got == [number(f"edge\x00{2**64 - 1}\x005\x004\x002\x00false\x00"), number("edge\x001\x002\x001\x001\x00true\x00l")]


def test_scalars(spark):
    one = lambda f, *v: spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v)))).select(f(*(F.col(f"c{i}") for i in range(len(v))))).first()[0]
    assert one(S.normalize_signature, " fn  f( a : B , c : D ) -> E ") == "fn f(a:B,c:D)->E"
    assert [one(S.parameter_count, s) for s in ("f(a: B<C, D>, e)", "f()", "f( )", "f", "f(a)")] == [2, 0, 0, None, 1]
    assert one(S.normal_path, "a/./b/../c//d") == "a/c/d" and one(S.last_segment, "a::b.c->d;") == "d"
    assert [one(S.is_test_file, p) for p in ("tests/a.rs", "src/Test/b.py", "a_test.go", "a.spec.ts", "contest.rs")] == [True, True, True, True, False]
    assert [one(S.excluded, p) for p in ("a/node_modules/b.js", "a/.tmp-1/b", "a/b.swp", "a/b.rs")] == [True, True, True, False]
    assert [one(S.stem, p) for p in ("src/Foo_test.rs", "test_bar.py", "a/.hidden")] == ["foo", "bar", ""]
    assert one(S.query_value, "a=1&b=x%20y") is None if False else one(lambda c: S.query_value(c, "b"), "a=1&b=x%20y") == "x y"


def test_exports_are_well_formed(spark):
    n, e = graph(spark, ['a"<b>&.rs', "c.rs"], [(0, 1)])
    text = lambda df: "\n".join(r["line"] for r in df.orderBy("part", "at").collect())
    for fmt in ("graphml", "gexf"):
        xml.dom.minidom.parseString(text(export.exported(n, e, fmt)))
    assert 'label="a\\"<b>&' in text(export.exported(n, e, "graphviz"))
    assert "#quot;" in text(export.exported(n, e, "mmd")) and text(export.mermaid(n, e, 1)).count("node_") == 1
    assert text(export.exported(n, e, "cyto")).count('"data"') == 3
    assert {r["path"] for r in export.exported(n, e, "vault").collect()} >= {"index.md"}
    with pytest.raises(ValueError):
        export.exported(n, e, "x")


def test_dispatch(spark):
    rows = [(1, "Trait", "T", "T", "a"), (2, "Method", "run", "T::run", "a"), (3, "Struct", "A", "A", "b"), (4, "Method", "run", "A::run", "b"), (5, "Function", "main", "main", "c")]
    e = spark.createDataFrame([("Contains", 1, 2), ("Contains", 3, 4), ("Implements", 3, 1), ("Calls", 5, 2)], "kind string, src long, dst long")
    assert [tuple(r) for r in compare.refined_calls(spark.createDataFrame(rows, NODES), e).collect()] == [(5, 2, 4, "Inferred")]


def test_flow(spark):
    ring = spark.createDataFrame([(1, 2, "Resolved"), (2, 3, "Inferred"), (3, 1, "Resolved"), (1, 3, "Possible")], "src long, dst long, confidence string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert [tuple(r) for r in compare.flow_paths(ring, ids(1), ids(3)).orderBy("length").collect()] == [("1 -> 3", 1, "Possible"), ("1 -> 2 -> 3", 2, "Inferred")]
    assert compare.flow_paths(ring.limit(0), ids(1), ids(3)).count() == 0

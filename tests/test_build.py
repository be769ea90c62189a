"""Sources to graph: scan, records, resolution, edges, invariants, incremental equals rebuild, facade, streams."""

import subprocess

import pytest
from pyspark.sql import functions as F

from graphloom.graph import CodeGraph
from graphloom.operators import build, incremental, resolve
from graphloom.sources import extract, repo
from graphloom.streaming import debounce

SOURCES = [
    ("src/util.py", "python", "def helper(x: int) -> int:\n    return x\n\nclass Base:\n    def run(self):\n        return helper(1)\n"),
    ("src/app.py", "python", "from src.util import helper as h, Base\n\nclass App(Base):\n    def go(self):\n        return h(2)\n\ndef main():\n    App().go()\n    missing()\n"),
    ("src/lib.rs", "rust", "use crate::work::{do_it, Thing};\nmod work;\npub fn entry() { do_it(1); Thing::new(); }\nfn helper() {}\n"),
    ("src/work.rs", "rust", "pub struct Thing;\npub trait Run { fn run(&self); }\nimpl Run for Thing { fn run(&self) { do_it(2); } }\npub fn do_it(x: i32) {}\n"),
    ("web/index.ts", "typescript", 'export { deep } from "./mid";\n'),
    ("web/mid.ts", "typescript", 'export { deep } from "./leaf";\n'),
    ("web/leaf.ts", "typescript", "export function deep() {}\n"),
    ("web/use.ts", "typescript", 'import { deep } from "./index";\nfunction call() { deep(); }\n'),
    ("bad.py", "python", "def broken(:\n"),
    ("main.go", "go", "package main\nfunc Same() {}\nfunc main() { Same() }\n"),
]


@pytest.fixture(scope="module")
def graph(spark):
    return CodeGraph.from_sources(spark.createDataFrame(SOURCES, "path string, language string, text string"))


def links(graph) -> set[tuple]:
    n = {r["id"]: r["qualified_name"] for r in graph.nodes.collect()}
    return {(r["kind"], n[r["src"]], n[r["dst"]]) for r in graph.edges.collect()}


def test_edges(graph):
    got = links(graph)
    assert {
        ("Contains", "src/util.py", "src/util.py::helper"),
        ("Imports", "src/app.py", "src/util.py"),
        ("Calls", "src/app.py::go", "src/util.py::helper"),
        ("Calls", "src/util.py::run", "src/util.py::helper"),
        ("Inherits", "src/app.py::App", "src/util.py::Base"),
        ("Instantiates", "src/app.py::main", "src/app.py::App"),
        ("Calls", "src/lib.rs::entry", "src/work.rs::do_it"),
        ("Instantiates", "src/lib.rs::entry", "src/work.rs::Thing"),
        ("Implements", "src/work.rs::Thing", "src/work.rs::Run"),
        ("Exports", "src/work.rs", "src/work.rs::do_it"),
        ("Calls", "web/use.ts::call", "web/leaf.ts::deep"),
        ("Calls", "main.go::main", "main.go::Same"),
    } <= got
    assert not any(k == "Calls" and "missing" in d for k, _, d in got)
    states = {(r["name"], r["state"]) for r in graph.resolved.where("edge = 'Calls'").collect()}
    assert ("missing", "Unresolved") in states and ("h", "Resolved") in states
    assert build.invalid(graph.nodes, graph.edges).count() == 0


def test_ambiguity(spark):
    files = [("a/x.py", "python", "def f(): pass\n"), ("b/x.py", "python", "def f(): pass\n"), ("c.py", "python", "from x import f\ndef g():\n    f()\n")]
    g = CodeGraph.from_sources(spark.createDataFrame(files, "path string, language string, text string"))
    r = g.resolved.where("edge = 'Calls' AND name = 'f'").first()
    assert r["state"] == "Ambiguous" and len(r["candidates"]) == 2
    assert not {k for k, s, d in links(g) if k in ("Calls", "Imports") and s.startswith("c.py")}


def test_selection(spark):
    found = spark.createDataFrame([(1, 10, 4, 3), (1, 11, 2, 1), (2, 10, 2, 1), (2, 11, 2, 4), (3, 10, 1, 0), (3, 10, 2, 1), (4, 10, 2, 1), (4, 10, 2, 4)], "ref long, id long, priority int, rule int")
    assert {(r["ref"], r["state"], r["id"]) for r in resolve.selected(found).collect()} == {(1, "Resolved", 11), (2, "Ambiguous", None), (3, "Resolved", 10), (4, "Resolved", 10)}


@pytest.mark.parametrize(
    ("language", "line", "want"),
    [
        ("rust", "use a::b::{c, d as e, f::*};", [("a::b", "c", None, False), ("a::b", "d", "e", False), ("a::b::f", None, None, True)]),
        ("python", "from a.b import c as d, e", [("a.b", "c", "d", False), ("a.b", "e", None, False)]),
        ("typescript", 'import x, { a as b } from "./m"', [("./m", "a", "b", False), ("./m", "default", "x", False)]),
        ("go", 'import f "x/y"', [("x/y", None, "f", False)]),
        ("c", "#include <a/b.h>", [("a/b.h", None, None, True)]),
        ("java", "import a.b.*;", [("a.b", None, None, True)]),
        ("csharp", "using A = B.C;", [("B.C", None, "A", False)]),
        ("kotlin", "import a.b as c", [("a", "b", "c", False)]),
        ("php", "use A\\B as C;", [("A", "B", "C", False)]),
        ("ruby", "require_relative 'x/y'", [("x/y", None, None, True)]),
        ("swift", "import Foo", [("Foo", None, None, True)]),
        ("zig", 'const a = @import("b.zig");', [("b.zig", None, "a", False)]),
    ],
)
def test_directives(language, line, want):
    assert extract.directives(language, line) == want


@pytest.mark.parametrize("language", sorted(extract.COMPILED))
def test_malformed_text_is_read(language):
    assert isinstance(extract.records("x", language, "}}{ (( class fn def \x00 é \" ' unclosed"), list)
    assert extract.records("x", language, "") == []


def test_languages():
    kinds = lambda lang, text: {(r[3], r[4], r[5]) for r in extract.records("f", lang, text) if r[2] == "symbol"}
    assert kinds("java", "class A { A() {} int m(int x) { return x; } } enum E { X }") == {("Class", "A", None), ("Constructor", "A", "A"), ("Method", "m", "A"), ("Enum", "E", None)}
    assert kinds("csharp", "namespace N { public class A { public int P { get; set; } void M() {} } }") == {("Namespace", "N", None), ("Class", "A", None), ("Property", "P", "A"), ("Method", "M", "A")}
    assert kinds("go", "package p\ntype I interface { F() }\nfunc (x *T) M() {}\n") == {("Package", "p", None), ("Interface", "I", None), ("Method", "M", "T")}
    assert kinds("swift", "protocol P {}\nstruct S { func f(a: Int) -> Int { return 1 } }") == {("Interface", "P", None), ("Struct", "S", None), ("Method", "f", "S")}
    assert kinds("zig", "pub const S = struct { fn m() void {} };\nfn f() void {}") == {("Struct", "S", None), ("Method", "m", "S"), ("Function", "f", None)}
    assert kinds("php", "namespace A; trait T { private function m() {} } function g() {}") == {("Namespace", "A", None), ("Trait", "T", None), ("Method", "m", "T"), ("Function", "g", None)}
    assert kinds("cpp", "namespace n { class A { void f() {} }; }\nint A::g(int x) { return x; }") == {("Namespace", "n", None), ("Class", "A", None), ("Method", "f", "A"), ("Method", "g", "A")}
    assert kinds("ruby", "module M\n class A\n  def x\n  end\n end\nend\ndef top\nend\n") == {("Module", "M", None), ("Class", "A", None), ("Method", "x", "A"), ("Function", "top", None)}


def test_scan_and_history(spark, tmp_path):
    root = tmp_path / "r"
    for name, text in (("a/x.py", "def f(): pass\n"), ("node_modules/y.js", "x"), ("h.h", "class A {};\n"), ("c.h", "int x;\n"), ("notes.txt", "t"), ("a/.tmp-1", "t"), ("a/__init__.py", "")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "link").symlink_to(root / "a")
    got = {r["path"]: r["language"] for r in repo.scan(spark, str(root)).collect()}
    assert got == {"a/x.py": "python", "h.h": "cpp", "c.h": "c", "notes.txt": None, "a/.tmp-1": None, "a/__init__.py": "python"}
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=A|B", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "a/x.py")
    git("commit", "-qm", "one")
    git("mv", "a/x.py", "a/y.py")
    git("commit", "-qam", "two")
    rows = {(r["file"], r["author"], r["additions"], r["binary"]) for r in repo.git_log(spark, str(root)).collect()}
    assert rows == {("a/x.py", "A|B", 1, False), ("a/y.py", "A|B", 0, False)}
    assert repo.synthetic(spark, 8).groupBy("language").count().count() == 4


def test_incremental_equals_rebuild(spark):
    schema = "path string, language string, text string"
    tag = lambda rows: spark.createDataFrame(rows, schema).withColumn("hash", F.sha2("text", 256)).withColumn("parser_version", F.lit(1))
    old = tag(SOURCES)
    kept, _ = incremental.updated_records(old, None, None)
    kept.write.mode("overwrite").parquet("/tmp/graphloom-test-records")
    kept = spark.read.parquet("/tmp/graphloom-test-records")
    nodes, edges, resolved = incremental.built(old, kept)
    new_rows = [r for r in SOURCES if r[0] != "web/leaf.ts"] + [("src/extra.py", "python", "def missing(): pass\n")]
    new_rows = [(p, lang, t.replace("def helper", "def helper2") if p == "src/util.py" else t) for p, lang, t in new_rows]
    new = tag(new_rows)
    records, changes = incremental.updated_records(new, old, kept)
    assert {(r["path"], r["change"]) for r in changes.where("change <> 'Unchanged'").collect()} == {("web/leaf.ts", "Deleted"), ("src/extra.py", "Added"), ("src/util.py", "Modified")}
    again = incremental.built(new, extract.extracted(new))
    assert {tuple(r) for r in records.collect()} == {tuple(r) for r in extract.extracted(new).collect()}
    changed = changes.where("change <> 'Unchanged'").select("path")
    touched = incremental.reverse_hints(kept, records, resolved, changed).union(incremental.affected(nodes, edges, changed, True)).union(changed).distinct()
    n2 = build.nodes_of(new, records)
    part = incremental.selective_edges(new, records, n2, edges, touched)
    assert {tuple(r) for r in part.collect()} == {tuple(r) for r in again[1].select(*part.columns).collect()}


def test_facade(graph, tmp_path):
    assert {r["qualified_name"] for r in graph.callers("src/util.py::helper").collect()} == {"src/app.py::go", "src/util.py::run"}
    assert graph.path("src/app.py::main", "src/util.py::helper").count() == 2
    assert graph.search("helper", limit=1).first()["qualified_name"].endswith("helper") and graph.search(" ").count() == 0
    assert "hotspots" in graph.report(3) and graph.stats().count() > 5
    assert graph.analyze("file", limit=2)["coupling"].count() == 2
    bundle = graph.context(symbol="src/util.py::helper", limit=200)
    assert "def helper" in "".join(r["text"] for r in bundle.collect())
    graph.save(f"{tmp_path}/g")
    again = CodeGraph.load(graph.nodes.sparkSession, f"{tmp_path}/g")
    assert links(again) == links(graph)
    assert all(d.count() == 0 for d in again.diff(graph).values())
    assert graph.export("dot").count() > 10 and graph.architecture().count() > 5
    with pytest.raises(ValueError):
        graph.path("nothing", "src/util.py::helper")


def test_coalescing(spark):
    seq = lambda *k: spark.createDataFrame([(list(k),)], "k array<string>").select(debounce.coalesced(F.col("k"))).first()[0]
    assert [seq("create", "modify"), seq("create", "remove"), seq("remove", "create"), seq("modify", "remove"), seq("modify", "modify")] == ["create", None, "modify", "remove", "modify"]
    rows = [("a", "modify", "2024-01-01 00:00:00.00"), ("a", "modify", "2024-01-01 00:00:00.03"), ("a", "modify", "2024-01-01 00:00:00.06"), ("b", "rename_from", "2024-01-01 00:00:00"), ("c", "rename_to", "2024-01-01 00:00:00"), ("d", "rename_to", "2024-01-01 00:00:01")]
    df = spark.createDataFrame(rows, "path string, kind string, ts string").withColumn("ts", F.to_timestamp("ts"))
    found = debounce.actions(df)
    assert {(r["path"], r["kind"]) for r in found.collect()} == {("a", "modify"), ("b", "rename_from"), ("c", "rename_to"), ("d", "rename_to")}
    assert {tuple(r) for r in debounce.renames(found).collect()} == {("modify", "a", None), ("rename", "c", "b"), ("create", "d", None)}
    assert {r["kind"] for r in debounce.checked(found.where("path = 'a'"), df.limit(0)).collect()} == {"remove"}


def test_stream_of_changes(spark, tmp_path):
    """A stream's bursts equal the batch's; snapshots survive a failed update and an overflow."""
    rows = [("a", f"2024-01-01 00:{m:02d}:00") for m in (0, 1, 30, 31)] + [("b", "2024-01-01 00:05:00"), ("z", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "path string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = debounce.bursts(stream, "10 minutes", "1 minute").writeStream.format("memory").queryName("bursts_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    assert q.awaitTermination(120)
    want = {tuple(r) for r in debounce.bursts(df, "10 minutes").where("path <> 'z'").collect()}
    assert {tuple(r) for r in spark.table("bursts_out").collect()} == want
    snap = debounce.Snapshots(spark, f"file://{tmp_path}/snap", capacity=3)
    run = snap.on_batch(lambda t, b: {"n": b.select("path")}, lambda: {"n": df.select("path")})
    run(df.limit(2), 0)
    assert (snap.status()["generation"], snap.tables()["n"].count()) == (1, 2)
    run(df, 1)  # beyond the capacity: rebuilt
    assert (snap.status()["generation"], snap.tables()["n"].count()) == (2, 6)
    bad = snap.on_batch(lambda t, b: 1 / 0, lambda: 1 / 0)
    bad(df.limit(1), 2)
    assert snap.health == "Failed" and snap.status()["generation"] == 2

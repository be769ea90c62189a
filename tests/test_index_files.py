"""Index files: round trip, every state, a flipped byte anywhere, pushed filters, order of loading, a save that breaks off."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphloom.graph import CodeGraph
from graphloom.operators import build
from graphloom.sources import index_files as ix
from graphloom.sources import repo
from tests.test_build import SOURCES


def rows(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.collect())


@pytest.fixture
def tree(tmp_path):
    for name, _, text in SOURCES:
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


@pytest.fixture(scope="module")
def graph(spark):
    return CodeGraph.from_sources(spark.createDataFrame(SOURCES, "path string, language string, text string"))


def test_round_trip_and_filters(spark, graph, tmp_path):
    root = f"{tmp_path}/i"
    ix.save(root, {"nodes": graph.nodes, "edges": graph.edges})
    t = ix.load(spark, root)
    assert t["nodes"].schema.simpleString() == graph.nodes.schema.simpleString()
    assert rows(t["nodes"]) == rows(graph.nodes) and rows(t["edges"]) == rows(graph.edges)
    one = ix.load(spark, root, {"edges": ["Calls"]})["edges"]
    calls = graph.edges.where("kind = 'Calls'")
    assert rows(one) == rows(calls) and calls.count() > 0
    assert one.rdd.getNumPartitions() < t["edges"].rdd.getNumPartitions()  # other sections are not opened
    both = t["edges"].where("kind = 'Calls'").union(t["edges"].where("kind = 'Imports'"))  # two filters on one table in one plan
    assert rows(both) == rows(graph.edges.where("kind IN ('Calls', 'Imports')"))
    assert rows(ix.load(spark, root, {"edges": ["none"]})["edges"]) == []


def test_nulls_empty_tables_and_frequent_kinds(spark, tmp_path):
    df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "x").otherwise("y").alias("kind"), "id", F.repeat(F.lit("t"), 900).alias("text"))
    ix.save(f"{tmp_path}/i", {"rows": df, "none": df.limit(0)})
    t = ix.load(spark, f"{tmp_path}/i")
    assert t["none"].collect() == [] and t["none"].dtypes == df.dtypes
    key = lambda d: d.groupBy("kind").agg(F.count("*"), F.sum("id"), F.sum(F.length("text"))).orderBy("kind").collect()
    assert key(t["rows"]) == key(df)
    assert ix.load(spark, f"{tmp_path}/i", {"rows": [None]})["rows"].count() == df.where("kind IS NULL").count()
    current = ix._current(f"{tmp_path}/i")
    table = f"{tmp_path}/i/{current['build']}/rows"
    assert max(os.path.getsize(f"{table}/{f}") for f in os.listdir(table)) < 2 * ix.SECTION_BYTES


def test_every_state(spark, tree, tmp_path):
    where = f"{tree}/.graphloom/index"
    now = lambda: ix.state(spark, where, repo.scan(spark, tree).drop("content"))[0]
    assert now() == ix.MISSING and ix.cache(spark, where) is None
    built = CodeGraph.current(spark, tree)
    assert now() == ix.CURRENT
    files, records = ix.cache(spark, where)
    assert rows(records) == rows(built.records) and files.count() == len(SOURCES)
    (tmp_path / "src/util.py").write_text("def other(): pass\n")
    assert now() == ix.STALE
    again = CodeGraph.current(spark, tree)
    assert now() == ix.CURRENT and again.nodes.where("name = 'other'").count() == 1
    assert len([f for f in os.listdir(where) if f.startswith("build-")]) == 1  # the build before is gone
    assert rows(CodeGraph.current(spark, tree).nodes) == rows(again.nodes)
    os.remove(tmp_path / "main.go")
    assert now() == ix.STALE

    pointer = f"{where}/{max(f for f in os.listdir(where) if f.startswith('current-'))}"
    data = open(pointer, "rb").read()
    for state, changed in ((ix.VERSION_MISMATCH, data[:4] + b"\x07" + data[5:]), (ix.CORRUPT, b"XXXX" + data[4:]), (ix.CORRUPT, data[:20]), (ix.CORRUPT, data[:-1])):
        with open(pointer, "wb") as f:
            f.write(changed)
        assert now() == state and ix.cache(spark, where) is None
        with pytest.raises(ix.IndexFault) as e:
            ix.load(spark, where)
        assert e.value.state == state
    CodeGraph.current(spark, tree)  # builds over what is damaged
    assert now() == ix.CURRENT


def test_a_flipped_byte_never_loads(spark, graph, tmp_path):
    root = f"{tmp_path}/i"
    ix.save(root, {"edges": graph.edges})
    table = f"{root}/{ix._current(root)['build']}/edges"
    for name in sorted(os.listdir(table))[:3] + ["manifest"]:
        whole = open(f"{table}/{name}", "rb").read()
        for at in (0, 5, 9, 13, 17, 25, 40, len(whole) // 2, len(whole) - 1):
            with open(f"{table}/{name}", "wb") as f:
                f.write(whole[:at] + bytes([whole[at] ^ 0x10]) + whole[at + 1 :])
            assert ix.state(spark, root)[0] in (ix.CORRUPT, ix.VERSION_MISMATCH), (name, at)
            if at in (0, 40):
                with pytest.raises((ix.IndexFault, PySparkException)):
                    ix.load(spark, root)["edges"].collect()
        with open(f"{table}/{name}", "wb") as f:
            f.write(whole)
    assert ix.state(spark, root)[0] == ix.CURRENT
    section = sorted(f for f in os.listdir(table) if f != "manifest")
    os.replace(f"{table}/{section[0]}", f"{table}/{section[1]}")  # a whole section, but another one
    assert ix.state(spark, root)[0] == ix.CORRUPT


def test_a_save_that_breaks_off(spark, graph, tmp_path):
    root = f"{tmp_path}/i"
    ix.save(root, {"nodes": graph.nodes, "edges": graph.edges})
    before = rows(ix.load(spark, root)["nodes"])
    broken = graph.edges.withColumn("label", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(PySparkException):
        ix.save(root, {"nodes": graph.nodes.where("kind = 'File'"), "edges": broken})
    assert rows(ix.load(spark, root)["nodes"]) == before and ix.state(spark, root)[0] == ix.CURRENT


def document(graph):
    """The graph as one JSON object, ids unsigned, names as another program writes them."""
    u = lambda n: n % 2**64
    nodes = [r.asDict(True) for r in graph.nodes.collect()]
    for n in nodes:
        n["id"], n["language"], n["visibility"] = u(n["id"]), n["language"] and n["language"].capitalize(), (n["visibility"] or "unknown").capitalize()
    edges = [{"id": u(r["id"]), "kind": r["kind"], "from": u(r["src"]), "to": u(r["dst"]), "confidence": r["confidence"]} | ({"label": r["label"]} if r["label"] else {}) for r in graph.edges.collect()]
    assert any(n["id"] >= 2**63 for n in nodes)
    return json.dumps({"nodes": nodes, "edges": edges}, indent=2)


def test_order_of_loading(spark, graph, tree, tmp_path):
    assert CodeGraph.open(spark, tree).source == "build"
    (tmp_path / "graph.json").write_text(document(graph))
    top = CodeGraph.open(spark, tree)
    assert top.source == "graph.json"
    assert rows(top.edges) == rows(graph.edges.select(*top.edges.columns))
    assert rows(top.nodes.select("id", "kind", "qualified_name", "language", "location")) == rows(graph.nodes.select("id", "kind", "qualified_name", "language", "location"))
    os.makedirs(tmp_path / ".graphloom", exist_ok=True)
    (tmp_path / ".graphloom/graph.json").write_text('{"nodes": [')
    with pytest.raises(ix.IndexFault):  # damaged, and not passed over
        CodeGraph.open(spark, tree)
    (tmp_path / ".graphloom/graph.json").write_text('{"nodes": []}')
    with pytest.raises(ix.IndexFault):
        CodeGraph.open(spark, tree)
    (tmp_path / ".graphloom/graph.json").write_text(document(graph))
    assert CodeGraph.open(spark, tree).source == ".graphloom/graph.json"
    graph.save(f"{tree}/.graphloom/index")
    assert CodeGraph.open(spark, tree).source == "index"
    assert build.invalid(CodeGraph.open(spark, tree).nodes, graph.edges).count() == 0

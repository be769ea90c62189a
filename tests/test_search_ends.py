"""Searches that stop: cycles and flows against plain enumeration, and graphs with far too many of them."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import compare, graphs


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def plain_cycles(edges, most):
    after, out = {}, []
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def grow(path):
        for b in sorted(after.get(path[-1], ())):
            if b == path[0] and len(path) > 1:
                out.append(list(path))
            elif b > path[0] and b not in path and len(path) < most:
                grow([*path, b])

    for a in sorted(after):
        grow([a])
    return sorted((len(p), " -> ".join(map(str, p))) for p in out)


def cycles(spark, edges, **kw):
    e = spark.createDataFrame(edges, "src long, dst long")
    nodes = sorted({x for p in edges for x in p})
    one = spark.createDataFrame([(x, 0, len(nodes), False) for x in nodes], "id long, number long, size long, trivial boolean")
    return [(r["length"], r["path"]) for r in graphs.cycles(e, one, **kw).collect()]


def test_first_cycles_of_a_complete_graph(spark):
    edges = [(a, b) for a, b in itertools.permutations(range(12), 2)]
    want = plain_cycles(edges, 3)  # two levels hold more than a hundred
    assert cycles(spark, edges) == want[:100]


def test_cycles_against_enumeration(spark):
    rnd = random.Random(3)
    edges = sorted({(rnd.randrange(14), rnd.randrange(14)) for _ in range(32)} - {(k, k) for k in range(14)})
    want = plain_cycles(edges, 6)
    assert sorted(cycles(spark, edges, max_length=6, max_cycles=None)) == want and len(want) > 5
    e = spark.createDataFrame(edges, "src long, dst long").withColumn("kinds", F.when(F.col("src") < F.col("dst"), F.array(F.lit("Calls"))).otherwise(F.array(F.lit("Calls"), F.lit("Imports"))))
    found = spark.createDataFrame([(p, n) for n, p in want], "path string, length long")
    for r in graphs.cycle_kinds(found, e).collect():
        at = list(map(int, r["path"].split(" -> ")))
        assert r["edge_kinds"] == [["Calls"] if a < b else ["Calls", "Imports"] for a, b in zip(at, [*at[1:], at[0]], strict=True)]


def plain_flows(edges, sources, sinks, depth):
    after, out = {}, []
    for a, b in edges:
        after.setdefault(a, []).append(b)

    def grow(path):
        if len(path) > 1 and path[-1] in sinks:
            out.append((len(path) - 1, " -> ".join(map(str, path))))
        if len(path) <= depth:
            for b in after.get(path[-1], ()):
                if b not in path:
                    grow([*path, b])

    for s in sources:
        grow([s])
    return sorted(out)


@pytest.mark.parametrize("ring", [True, False])
def test_flows_against_enumeration(spark, ring):
    rnd = random.Random(7)
    edges = {(rnd.randrange(12), rnd.randrange(12)) for _ in range(30)}
    edges = sorted((a, b) for a, b in edges if a != b and (ring or a < b))
    flow = spark.createDataFrame([(a, b, "Resolved") for a, b in edges], "src long, dst long, confidence string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    want = plain_flows(edges, [0, 1], {9, 10, 11}, 6)
    got = lambda **kw: [(r["length"], r["path"]) for r in compare.flow_paths(flow, ids(0, 1), ids(9, 10, 11), 6, **kw).collect()]
    assert sorted(got()) == want and want
    assert got(max_paths=3) == want[:3]


def test_ladder_of_a_billion_paths(spark):
    """Thirty rungs of two ways each: a few paths come out, without the others being made."""
    flow = []
    for k in range(30):
        flow += [(10 * k, 10 * k + 1), (10 * k, 10 * k + 2), (10 * k + 1, 10 * k + 10), (10 * k + 2, 10 * k + 10)]
    flow += [(2, 990), (990, 991)]  # a dead end
    df = spark.createDataFrame([(a, b, "Inferred") for a, b in flow], "src long, dst long, confidence string")
    one = lambda i: spark.createDataFrame([(i,)], "id long")
    assert compare.flow_paths(df, one(0), one(300)).count() == 0  # beyond fifteen steps
    got = compare.flow_paths(df, one(0), one(60), 60, 4).collect()
    assert [r["length"] for r in got] == [12] * 4 and got[0]["path"].startswith("0 -> 1 -> 10 -> 11") and all(r["confidence"] == "Inferred" for r in got)
    names = spark.createDataFrame([(0, "Env::Source"), (60, "db.Sink"), (1, "x")], "id long, name string")
    assert [r["path"] for r in compare.named_flows(df, names, "source", "SINK", max_depth=12, max_paths=4).collect()] == [r["path"] for r in got]

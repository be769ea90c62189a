"""What resolution joins before it multiplies rows: names of members, names of few symbols; and its rows either way."""

import os

from graphloom.operators import resolve
from graphloom.sources import tables as src

REFS = "ref long, edge string, name string, caller_name string, caller_container string"


def test_pieces_only_of_names_that_members_have(spark):
    refs = spark.createDataFrame([(1, "Calls", "run", "a.ts::Shop.go", None), (2, "Calls", "f1", "a.ts::Shop.go", None), (3, "Calls", "run", "a.ts::go", "Sh"), (4, "References", "run", "b.ts", "Other")], REFS)
    symbols = spark.createDataFrame([(10, "run", "Shop"), (11, "run", "Other"), (12, "f1", None)], "id long, name string, container string")
    found = resolve.of_callers_type(src.spread(refs), symbols)
    assert sorted(map(tuple, found.collect())) == [(1, 10), (4, 11)]
    below = found._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[1]
    assert "LeftSemi" in below


def test_few_homes_and_many(spark, monkeypatch):
    asked = spark.createDataFrame([(k, f"s{k % 3}.ts", n) for k in range(6) for n in ("one", "none", "all")], "ref long, file string, name string")
    hop = spark.createDataFrame([("s0.ts", "p0.ts"), ("s0.ts", "p1.ts"), ("s1.ts", "p9.ts")], "file string, at string")
    symbols = spark.createDataFrame([(100, "p0.ts", "one"), (101, "p9.ts", "one")] + [(k, f"p{k % 10}.ts", "all") for k in range(20)], "id long, at string, name string")
    every = lambda: sorted(resolve.through_imports(asked, hop, symbols).select("ref", "file", "name", "at", "id").collect())
    want = sorted((r["ref"], r["file"], r["name"], h["at"], s["id"]) for r in asked.collect() for h in hop.collect() for s in symbols.collect() if r["file"] == h["file"] and h["at"] == s["at"] and s["name"] == r["name"])
    for few in (0, 2, 100):
        monkeypatch.setattr(resolve, "FEW_HOMES", few)
        assert list(map(tuple, every())) == want and len(want) == 16


def test_tables_between_are_columns_and_may_pass(spark):
    with src.passing(spark):
        a = src.dealt(spark.range(5).selectExpr("id", "repeat('x', 100) AS text"))
        assert src.held(a) is a and a.count() == 5
        where = a.kept_at.removeprefix("file://").removeprefix("file:")
        assert any(f.endswith(".parquet") for f in os.listdir(where))
    assert not os.path.exists(where)
    b = src.dealt(spark.range(3))
    assert b.count() == 3 and src.held(spark.range(2)).count() == 2

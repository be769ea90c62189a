"""Byte spans against plain slices of encoded text, paths that leave the root, and the queries of plans/files.py against SQL."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import context, intel
from graphloom.plans import files

from test_plans import plain

DIR = "/root/testdata/sf0.001"
LETTERS = "ab é€😀\n"


@pytest.mark.parametrize("name", sorted(files.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(files.ORACLES[name]).df()
    got = files.QUERIES[name](spark, DIR).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want) and len(got)


def texts(n, letters=LETTERS):
    r = random.Random(5)
    return ["", "\n", "a\n", "😀"] + ["".join(r.choice(letters) for _ in range(r.randrange(1, 14))) for _ in range(n)]


def test_every_cut(spark):
    cases = [(t, a, b) for t in texts(25) for a in range(-1, len(t.encode()) + 2) for b in range(-1, len(t.encode()) + 2)]

    def want(t, a, b):
        data = t.encode()
        a, b = (min(max(x, 0), len(data)) for x in (a, b))
        inner = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
        while inner(a):
            a += 1
        while b > a and inner(b):
            b -= 1
        return data[a : max(a, b)].decode()

    got = spark.createDataFrame(cases, "t string, a int, b int").withColumn("cut", T.byte_cut(F.col("t"), F.col("a"), F.col("b"))).collect()
    assert [(r.t, r.a, r.b, r.cut) for r in got if r.cut != want(r.t, r.a, r.b)] == [] and len(got) == len(cases)


def test_every_span(spark):
    r = random.Random(6)
    cases = [(t, *(r.randrange(0, 7) for _ in range(4))) for t in texts(60) for _ in range(25)]

    def want(t, sl, sc, el, ec):
        data = t.encode()
        starts = [0] + [i + 1 for i, c in enumerate(data) if c == 10]
        if max(sl - 1, 0) >= len(starts):
            return ""
        a = starts[max(sl - 1, 0)] + max(sc - 1, 0)
        b = min((starts[max(el - 1, 0)] if max(el - 1, 0) < len(starts) else len(data)) + max(ec - 1, 0), len(data))
        try:
            return data[min(a, b) : b].decode()
        except UnicodeDecodeError:
            return ""

    got = spark.createDataFrame(cases, "t string, sl int, sc int, el int, ec int").withColumn("s", T.span_text(*(F.col(c) for c in ("t", "sl", "sc", "el", "ec")))).collect()
    assert [tuple(r) for r in got if r.s != want(*r[:5])] == []


def test_slices(spark):
    content = "one é\r\ntwo\n€uro\n"
    spans = [(1, 1, 1, 1, 1), (2, 1, 5, 1, 1), (10, 1, 6, 1, 1), (3, 1, 1, 1, 6), (4, 1, 2, 3, 3), (5, 3, 2, 9, 0), (6, 0, 1, 2, 1), (7, 5, 1, 6, 1), (8, 2, 3, 2, 2), (9, 3, 2, 2, 1)]
    df = spark.createDataFrame([(i, "x/../f.py", *s) for i, *s in spans] + [(20, "none.py", 1, 1, 1, 1)], "id long, file string, start_line int, start_col int, end_line int, end_col int")
    got = {r["id"]: r["text"] for r in context.slices(df, spark.createDataFrame([("f.py", content)], "path string, content string")).collect()}
    assert got == {1: "one é", 2: "é", 10: "", 3: "one ", 4: "ne é\ntwo\n", 5: "uro\n", 6: "", 7: "", 8: "", 9: "", 20: ""}


def test_paths_inside_the_root(spark):
    read = lambda *p: [r[0] for r in spark.createDataFrame([(x,) for x in p], "p string").select(T.inside_root(F.col("p"))).collect()]
    assert read("a/b.py", "./a//b.py", "a/../b/./c", "a/.b/..c", "") == ["a/b.py", "a/b.py", "b/c", "a/.b/..c", ""]
    for bad in ("../a", "a/../../b", "/etc/passwd"):
        with pytest.raises(PySparkException, match="escapes the root"):
            read(bad)


def test_stems_within_stems(spark):
    r = random.Random(7)
    stems = {"".join(r.choice("ab") for _ in range(r.randrange(1, 9))) for _ in range(60)}
    names = [(f"s/{s}.go", s, False) for s in sorted(stems)[::2]] + [(f"t/{s}_test.go", s, True) for s in sorted(stems)[1::2]] + [("s/_test.x", "", False)]
    nodes = spark.createDataFrame([(i, "File", f, f, f) for i, (f, _, _) in enumerate(names)], "id long, kind string, name string, qualified_name string, file string")
    got = [(x["source_file"], x["test_file"]) for x in intel.discovered_tests(nodes, spark.createDataFrame([], "kind string, src long, dst long")).collect()]
    want = [(f, g) for f, s, a in names if not a for g, t, b in names if b and (s in t or t in s)]
    assert sorted(got) == sorted(want)

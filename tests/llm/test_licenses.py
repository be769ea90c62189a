"""License scans against plain windows: lines and marks inside, edges of blocks, nulls, repeats, long texts, clashing names."""

import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import op12_licenses as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, templates=op.TEMPLATES, percent=op.PERCENT):
    """(n_words, places, blocks) by looking at every window."""
    ws = split(text)
    places = sorted((i, label) for phrase, label in op.PHRASES for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split())
    blocks = []
    for k, (label, t) in enumerate(templates):
        its = split(t)
        half, tokens = 8, set(its)
        while half < len(its):
            half *= 2
        for a in range(0, len(ws), half):
            n = len(tokens & set(ws[a : a + 2 * half]))
            if 100 * n >= percent * len(tokens):
                blocks.append((label, k, a, min(a + 2 * half, len(ws)), n, len(tokens)))
    return len(ws), [(label, i) for i, label in places], blocks


def texts():
    rnd = random.Random(5)
    filler = ["the", "of", "x", "work", "Licensed", "by", "4", "ñ", "software", "under", "free", "License", "any"]
    out = [None, "", "---", "CC-BY cc by 4.0. General Public License all rights reserved. ALL RIGHTS\nRESERVED", "cc", "all rights", "cc bye"]
    for _, t in op.TEMPLATES:
        some = t.split()
        for lost in (0, 1, 2, 4):
            kept = [w for w in some if w not in rnd.sample(some, min(lost, len(some)))]
            out.append(" ".join(rnd.choices(filler, k=rnd.randrange(90))) + "\n * " + "\n# ".join(kept) + " " + " ".join(rnd.choices(filler, k=rnd.randrange(30))))
            out.append(" ".join(rnd.sample(kept, len(kept))))
    out.append(("The quick work. " * 40_000) + op.TEMPLATES[0][1] + "A" * 100_000)
    return out + out[:20]


def test_against_windows(spark):
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("n_words", "places", "blocks", "word", "n"):
        df = df.withColumn(c, F.lit("x"))
    got = [(r["doc_id"], r["n_words"], [tuple(p) for p in r["places"]], [tuple(b) for b in r["blocks"]]) for r in op.scan(df).collect()]
    want = [(k, *plain(t)) for k, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(bool(r[3]) for r in want) > 100 and sum(len(r[3]) > 0 and not r[2] for r in want) > 50


@pytest.mark.parametrize("percent", [1, 50, 100])
def test_other_thresholds_and_templates(spark, percent):
    templates = (("a", "one two three"), ("b", "two two two"), ("c", " ".join(f"w{i}" for i in range(40))))
    rnd = random.Random(percent)
    rows = [(k, " ".join(rnd.choices(["one", "two", "three", "four", *(f"w{i}" for i in range(40))], k=rnd.randrange(120)))) for k in range(150)]
    got = {r["doc_id"]: [tuple(b) for b in r["blocks"]] for r in op.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates, (), percent).collect()}
    assert got == {k: plain(t, templates, percent)[2] for k, t in rows}


def test_empty_table_and_no_templates(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op.scan(none).count() == 0
    assert [tuple(r) for r in op.scan(spark.createDataFrame([(1, "all rights reserved")], "doc_id long, text string"), (), ()).collect()] == [(1, 3, [], [])]

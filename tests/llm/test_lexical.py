"""Lexical search against plain scoring: ties, nulls, repeats, long texts, blocks, chunks, clashing names."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import op11_lexical as op

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items, k=50):
    held = [(d, Counter(TERM.findall(low(t)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    documents, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(low(t)))
    out = []
    for i, terms in asked.items():
        best = []
        for d, c in held:
            m = 50 + (50 * sum(c.values()) * documents) // total
            s = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                best.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if n else d, -s) for r, (s, n, d) in enumerate(sorted(best)[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, **kw):
    got = op.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(3)
    words = ["Ab", "b-c", "ñé", "x1", "the", "die", "ſ", "K", "K", "zz", "q_r", "7"]
    docs = [(rnd.randrange(400), " ".join(rnd.choices(words, range(12, 0, -1), k=rnd.randrange(40)))) for _ in range(300)]
    docs += [(900 + i, "the die zz") for i in range(80)] + [(None, "é7 ab"), (None, "é7 ab"), (5, None), (6, ""), (7, "-- !")]
    docs.append((8, "x1 the " * 30_000 + "A" * 200_000))
    items = [(1, "zz THE"), (2, "ab B é7"), (3, None), (4, "nowhere"), (5, ""), (None, "x1"), (6, "7 7 7 k"), (1, "x1"), (1, "zz the")]
    return docs, items


def test_against_plain_scoring(spark, corpus):
    docs, items = corpus
    want = plain(docs, items)
    assert run(spark, docs, items) == want
    assert {r[0] for r in want} == {1, 2, None, 6} and any(r[2] is None for r in want)


@pytest.mark.parametrize("k", [1, 3, 500])
def test_other_depths_blocks_and_chunks(spark, corpus, k, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(op, "BLOCK_DOCS", 37)
    assert run(spark, docs, items, k=k, chunk_terms=3) == plain(docs, items, k)


def test_empty_tables_and_clashing_names(spark, corpus):
    docs, items = corpus
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []
    assert run(spark, [(1, "a b"), (2, "c")], [(None, "a")]) == plain([(1, "a b"), (2, "c")], [(None, "a")])
    d = spark.createDataFrame(docs, DOCS)
    for c in ("id", "item", "term", "terms", "score", "rank", "ids", "sizes"):
        d = d.withColumn(c, F.lit("x"))
    i = spark.createDataFrame(items, ITEMS)
    for c in ("item", "term", "id", "doc_id"):
        i = i.withColumn(c, F.lit("x"))
    assert sorted((tuple(r) for r in op.search(d, i).collect()), key=repr) == plain(docs, items)


def test_carry_arithmetic_and_slices():
    rnd = np.random.default_rng(1)
    for n, terms in ((1, 1), (64, 3), (1000, 9), (130, 40)):
        values = [np.where(rnd.random(n) < 0.4, rnd.integers(1, 1 << 35, n), 0) for _ in range(terms)]
        parts = []
        for v in values:
            place = np.flatnonzero(v)
            if len(place):
                parts.append(op.sliced(place, v[place], -(-n // 64)))
        if not parts:
            continue
        total = sum(values)
        sums = op.added(parts)
        for k in (1, 7, n):
            places, got = op.top(sums, k)
            want = sorted((-int(t), j) for j, t in enumerate(total) if t)[:k]
            assert sorted(zip((-got).tolist(), places.tolist(), strict=True)) == want

"""Decontamination against alignment of every document with every item, at growing shares of edited words; clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import op4_decontam as op


def corpus(kind, share, rnd):
    vocab = [f"word{k}" for k in range(900)]
    items = [(k, " ".join(rnd.choices(vocab, k=30))) for k in range(40)]
    docs = []
    for k in range(80):
        copy = items[k % 40][1].split()
        for at in rnd.sample(range(30), int(30 * share)):
            copy[at] = {"replace": rnd.choice(vocab), "insert": f"{copy[at]} {rnd.choice(vocab)}", "delete": ""}[kind]
        docs.append((k, " ".join([*rnd.choices(vocab, k=60), *copy, *rnd.choices(vocab, k=60)])))
    return items, docs


@pytest.mark.parametrize("kind", ["replace", "insert", "delete"])
@pytest.mark.parametrize("share", [0.05, 0.2, 0.3])
def test_recall_of_all_pairs(kind, share):
    """A pair counts if whole alignment reaches the score; seeds must find nine tenths of these, and nothing else."""
    rnd = random.Random(f"{kind}{share}")
    items, docs = corpus(kind, share, rnd)
    split = [(i, op.words(t)) for i, t in items]
    every = {(d, i) for d, t in docs for i, ws in split if op.align(ws, op.words(t))[0] / (2 * len(ws)) >= op.SCORE}
    counts: dict[str, int] = {}
    for _, t in docs:
        for g in op.grams(op.words(t), op.SEED):
            counts[g] = counts.get(g, 0) + 1
    chosen = [(i, ws, op.rarest(op.grams(ws, op.SEED), counts, op.LEAST_SEEDS)) for i, ws in split]
    matcher = op.Matcher(chosen, op.SEED, op.SCORE)
    found = {(d, m[0]) for d, t in docs for m in matcher.matches(t)}
    print(kind, share, len(every), len(found & every) / max(1, len(every)))
    assert found <= every and len(found) >= 0.9 * len(every)
    assert share > 0.2 or len(every) == 80


def test_query_finds_what_all_pairs_find(spark):
    items, docs = corpus("replace", 0.1, random.Random(1))
    every = {(d, i) for d, t in docs for i, u in items if op.align(op.words(u), op.words(t))[0] / (2 * len(op.words(u))) >= op.SCORE}
    d = spark.createDataFrame([*docs, (None, None), (900, ""), (901, "word1 " * 50_000), docs[0]], "doc_id long, text string")
    b = spark.createDataFrame([*items, (500, None), (501, "")], "item_id long, text string")
    got = op.contamination(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == every and len(got) == len(every) + sum(d == 0 for d, _ in every)
    for c in ("__id", "__key", "found_id", "found_key", "key", "id"):
        d = d.withColumn(c, F.lit("x"))
    left = op.decontaminate(d, b)
    assert left.columns == d.columns and {r["doc_id"] for r in left.collect()} == {None, 900, 901} | ({k for k, _ in docs} - {k for k, _ in every})

"""Tries against plain prefixes: buckets of every size, long copies, a huge conversation, nulls, repeats, ties, clashing names."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from graphloom.llm import op13_trie as op

CONV = "conv_id long, turn long, role string, text string"


def sequences(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in turns:
        h, base = crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    return out


def plain(seqs):
    members, kids = defaultdict(list), defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[: d - 1]].add(s[:d])
    leaves, saved, rows = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
        ended = sorted(c for c in members[k] if len(seqs[c]) == len(k))
        digest = hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()
        rows.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves[k], saved[k], digest))
    return sorted(rows, key=repr)


def run(spark, rows, local_rows):
    turns = op.originals(spark.createDataFrame(rows, CONV))
    got = op.trie(*op.rebuilt(turns), local_rows)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.fixture(scope="module")
def table():
    rnd = random.Random(2)
    rows = []
    for c in [*range(-120, 130), *range(1000, 1060), 7777, 10**12 + 5]:
        for t in range(rnd.randrange(1, 9)):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bb", "ünï", "", None, "z" * 50])))
    rows += [(c, t, "user", f"same {t}") for c in range(2000, 2040) for t in range(30)]  # copies
    rows += [(c, t, "user", f"same {t}" if t < 20 else f"{c}") for c in range(2040, 2060) for t in range(25)]  # part after 20 turns
    rows += [(3000, t, "user", f"long {t}") for t in range(1500)] + [(3001, t, "user", f"long {t}") for t in range(1400)]
    rows += [(4000, None, "user", "n"), (4000, None, "user", "n"), (4000, 3, "b", "x"), (4000, 3, "a", "y"), (4000, 3, "a", "x"), (None, 1, "user", "lost")]
    rows += [(5003, 0, "user", "x"), (5000, 0, "u", "only")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("local_rows", [20, 700, 10**6])
def test_against_prefixes(spark, table, local_rows):
    assert run(spark, table, local_rows) == plain(sequences(table))


def test_multikey_quicksort_alone():
    rnd = random.Random(9)
    for _ in range(50):
        members = sorted(rnd.sample(range(1000), rnd.randrange(1, 40)))
        seqs = [[7, *(rnd.randrange(3) for _ in range(rnd.randrange(6)))] for _ in members]
        chars = [[10 + x for x in s] for s in seqs]
        out = [[] for _ in range(9)]
        op.grown(members, seqs, chars, 1, 0, out)
        want = plain({m: tuple((x, "c" * (10 + x)) for x in s) for m, s in zip(members, seqs, strict=True)})
        got = sorted(zip(*out[:8], strict=True), key=repr)
        assert [g for g in got if g[1] > 1] == [w for w in want if w[1] > 1] and len(got) == len(want) - 1


def test_small_and_empty_tables(spark):
    assert run(spark, [], 5) == [] and run(spark, [(None, 1, "a", "b")], 5) == []
    for rows in ([(100, 1, "a", "b")], [(103, 0, "u", "x"), (104, 0, "u", "x")], [(101, k, "u", "x") for k in range(9)]):
        assert run(spark, rows, 2) == plain(sequences(rows))
    df = spark.createDataFrame([(100, 1, "a", "b"), (1, 2, "c", "d")], CONV)
    for c in ("conv", "at", "chars", "said", "head", "top", "base", "h", "total"):
        df = df.withColumn(c, F.lit("x"))
    assert op.trie(*op.rebuilt(op.originals(df))).count() == 1 + 1 + (2 if crc32(b"1") % 6 == 0 else 0)


def test_running_sums_over_partitions(spark):
    rnd = random.Random(4)
    rows = [(k, i, rnd.randrange(10)) for k, n in ((1, 3), (2, 4000), (3, 1), (4, 700)) for i in range(n)]
    rnd.shuffle(rows)
    got = op.running(spark.createDataFrame(rows, "k long, i long, v long").repartition(5), ["k"], [F.asc("i")], "v").collect()
    sums = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["k"], r["i"])):
        sums[r["k"]] += r["v"]
        assert r["at"] == r["i"] and r["total"] == sums[r["k"]]
    assert len(got) == len(rows)

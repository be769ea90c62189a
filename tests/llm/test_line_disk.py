"""Line deduplication moves a part of the tokens, loses no match by it, and leaves no shuffle files behind."""

import os
import random
import time

import numpy as np
import pytest

from graphloom.llm import op3_line_dedup, setjoin

RNG = random.Random(31)


def written(spark) -> int:
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()


def on_disk(spark) -> int:
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = [os.path.join(d, f) for top in dirs for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_")]
    return sum(os.path.getsize(f) for f in files if os.path.exists(f))


def test_little_is_moved_or_left(spark):
    docs = [(i, "\n".join(" ".join(f"{RNG.randrange(10**6):x}" for _ in range(60)) for _ in range(4))) for i in range(2500)]
    docs += [(3000 + i, docs[i][1]) for i in range(10)]
    size = sum(len(t) for _, t in docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).localCheckpoint()
    before, there = written(spark), on_disk(spark)
    gone = op3_line_dedup.removed_lines(df)
    assert written(spark) - before < size / 2
    for _ in range(60):
        if on_disk(spark) - there < size / 10:
            break
        time.sleep(0.25)
    assert on_disk(spark) - there < size / 10
    assert sorted((r["id"], tuple(r["lines"])) for r in gone.collect()) == [(3000 + i, (0, 1, 2, 3)) for i in range(10)]


@pytest.mark.parametrize("percent", [50, 70, 80])
def test_sieve_loses_no_match(spark, monkeypatch, percent):
    sets = [sorted(RNG.sample(range(60), RNG.randrange(1, 9))) for _ in range(400)]
    sets += [sorted(RNG.sample(range(1000, 9000), RNG.randrange(1, 60))) for _ in range(400)]
    for s in list(sets[::5]):  # near copies
        sets.append(sorted({*s[: len(s) - len(s) // 9], *RNG.sample(range(1000, 9000), len(s) // 9)}))
    sets += [[], []]
    monkeypatch.setattr(setjoin, "CHUNK_SETS", 90)
    hashed = [np.sort(np.array([hash((x, 5)) % 2**61 for x in s], np.uint64)) for s in sets]

    def make(b):
        from graphloom.llm import words

        ids = b.column(0).to_numpy()
        tokens = np.concatenate([np.zeros(0, np.uint64), *(hashed[i] for i in ids)])
        at = np.r_[0, np.cumsum([len(hashed[i]) for i in ids])]
        meta = np.zeros(len(ids), setjoin.META)
        meta["id"], meta["n"] = ids, np.diff(at)
        d = words.digests(tokens, at)
        meta["d0"], meta["d1"] = d[:, 0], d[:, 1]
        return meta, tokens, at

    src = spark.range(len(sets)).repartition(3).localCheckpoint()
    copies, left = setjoin.sieve(src, make, percent, 10)
    hashes = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["hashes"], np.uint64) for r in left.collect())])
    meta = np.zeros(len(sets), setjoin.META)
    meta["id"] = np.arange(len(sets))
    stays = dict(enumerate(np.isin(setjoin.place_hash(meta), hashes).tolist()))
    copied = {i for i, s in enumerate(sets) if s and s in sets[:i]}
    assert {r["id"] for r in copies.collect()} == copied
    plain = [set(s) for s in sets]
    matched = {i for i, a in enumerate(plain) if a and i not in copied and any(j not in copied and i != j and setjoin.linked(len(a & b), len(a), len(b), percent) for j, b in enumerate(plain) if b)}
    assert matched and all(stays[i] for i in matched)
    assert not any(stays[i] for i in copied) and sum(stays.values()) < len(sets) - len(copied)
    bits = setjoin.filter_of(left)
    assert setjoin.in_filter(bits, hashes).all() and setjoin.in_filter(bits, setjoin.place_hash(meta)).mean() < (len(hashes) / len(sets)) + 0.1

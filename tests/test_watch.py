"""Watching a tree: no event lost or repeated over restarts; keyed state equals the reducer and survives a restart."""

import functools
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import debounce, watch


def test_listings_over_restarts(spark, tmp_path):
    root, state, out = tmp_path / "root", tmp_path / "state", []
    (root / "a").mkdir(parents=True)
    (root / "node_modules").mkdir()

    def put(name, text):
        (root / name).write_text(text)

    def run():
        q = watch.watched(spark, str(root), str(state)).writeStream.foreachBatch(lambda df, n: out.extend(tuple(r) for r in df.select("path", "kind").collect())).option("checkpointLocation", str(tmp_path / "ck")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        got = sorted(out)
        out.clear()
        return got

    put("a/x.py", "1")
    put("a/y.py", "1")
    put("node_modules/z.js", "1")
    put("a/x.py~", "1")
    assert run() == [("a/x.py", "create"), ("a/y.py", "create")]
    assert run() == []
    put("a/x.py", "22")
    os.remove(root / "a/y.py")
    put("b.py", "1")
    assert run() == [("a/x.py", "modify"), ("a/y.py", "remove"), ("b.py", "create")]
    assert run() == [] and len(list(state.glob("listing-*.json"))) <= 2


def test_batches_are_read_again_alike(tmp_path):
    reader = watch.Listings(str(tmp_path / "root"), str(tmp_path / "state"))
    (tmp_path / "root").mkdir()
    start = reader.initialOffset()
    assert reader.read(start)[1] == start
    (tmp_path / "root/x").write_text("1")
    rows, end = reader.read(start)
    (tmp_path / "root/x").write_text("22")  # what comes later is not in that batch
    assert list(rows) == list(watch.Listings(reader.root, reader.state).readBetweenOffsets(start, end))
    later, last = reader.read(end)
    assert [(p, k) for p, k, _ in later] == [("x", "modify")] and last["listing"] == 2
    reader.commit(last)
    assert sorted(os.listdir(reader.state)) == ["listing-2.json"]


@pytest.mark.parametrize("seed", range(3))
def test_one_reducer(spark, seed):
    rnd = random.Random(seed)
    rows = [([rnd.choice(["create", "modify", "remove"]) for _ in range(rnd.randrange(1, 7))],) for _ in range(60)]
    got = [r["kind"] for r in spark.createDataFrame(rows, "k array<string>").coalesce(1).select(debounce.coalesced(F.col("k")).alias("kind")).collect()]
    assert got == [functools.reduce(watch.merged, k, None) for (k,) in rows]


def test_quiet_actions_over_a_restart(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    out: list[tuple] = []
    rnd = random.Random(4)
    events = [(f"p{rnd.randrange(12)}", rnd.choice(["create", "modify", "remove"]), k) for k in range(80)]
    events += [("old.py", "rename_from", 80), ("new.py", "rename_to", 81)]
    want = {p: functools.reduce(watch.merged, [k for q, k, _ in events if q == p], None) for p, _, _ in events}

    def write(rows, name):
        df = spark.createDataFrame(rows, "path string, kind string, n long").select("path", "kind", F.timestamp_seconds(F.col("n") + 1_700_000_000).alias("ts"))
        df.coalesce(1).write.parquet(f"file://{tmp_path}/part-{name}")
        for f in (tmp_path / f"part-{name}").glob("*.parquet"):
            os.replace(f, tmp_path / "in" / f.name)

    def start():
        stream = spark.readStream.schema(watch.EVENT).parquet(f"file://{tmp_path}/in")
        keep = lambda df, n: out.extend(tuple(r) for r in watch.flushed(df).collect())
        return watch.quiet_actions(stream, 15_000).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/ck").start()

    try:
        (tmp_path / "in").mkdir()
        write(events[:50], 1)
        q = start()
        until = time.time() + 120
        while not any(p["numInputRows"] for p in q.recentProgress) and time.time() < until:
            time.sleep(0.5)
        q.stop()
        assert out == []  # nothing was quiet for long enough: it all waits in the state
        write(events[50:], 2)
        q = start()
        until = time.time() + 240
        while len({p for _, p, _ in out}) < sum(k is not None for k in want.values()) - 1 and time.time() < until:
            time.sleep(0.5)
        q.stop()
        assert q.exception() is None
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    kinds = {p: k for p, k in want.items() if k and not k.startswith("rename")}
    got = {p: k for k, p, old in out if old is None}
    renamed = {(p, old) for k, p, old in out if k == "rename"}
    assert got == {**kinds} and renamed == {("new.py", "old.py")} or got == {**kinds, "new.py": "create", "old.py": "remove"}
    assert len(out) == len({p for _, p, _ in out})  # no path twice

"""Near duplicates among embeddings: exact search over shards that overlap by the angle.

Equal vectors of a label are one class that takes part once.  Centres are drawn
from a bounded sample of the classes of each label.  Every class is a member of
the shard of its nearest centre and looks for links there and in every other
shard that can hold a vector within the angle of ``cosine``: those whose dividing
plane lies within that angle.  Members of a shard are compared with all that
look there, in slices, by cosine in double precision.  A task gives the number of
links of each of its rows and a spanning forest of them, never the pairs, so its
rows do not grow with the square of a group of near copies.

Vectors that are null, zero, of a length other than the usual one of their
label, or with null or non-finite components, and rows with a null label, are
linked with nothing.  Repeated rows (same id, vector and label) count as one
vector and are all kept.  One id may stand for several vectors, under one label
or more: each row has the links of its own vector, in its own label, and ids
alone tie nothing together.  Rows with a null id are kept and link with nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

COSINE = 0.98
#: Rows a centre stands for.
PER_CENTRE = 1500
#: Centres of one level: more rows than MAX_CENTRES * PER_CENTRE make larger shards, worked off in slices.
MAX_CENTRES = 4096
#: Rows compared with a slice at once.
BLOCK = 256


def unit(v) -> np.ndarray | None:
    """The vector scaled to length 1, or None if it links with nothing."""
    if v is None or any(x is None for x in v):
        return None
    a = np.asarray(v, np.float64)
    size = np.linalg.norm(a) if len(a) and np.isfinite(a).all() else 0.0
    return a / size if size > 0 and np.isfinite(size) else None


def digest_of(v: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(v.tobytes(), digest_size=16).digest()


def scan(x: np.ndarray, ids: np.ndarray, copies: np.ndarray, members: np.ndarray, cosine: float, asking: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Copies of ``members`` that each of the first ``asking`` rows is linked with, and links that connect what all these links connect."""
    others = np.zeros(asking, np.int64)
    tree, forest = np.arange(len(x)), []
    xm, im, cm = x[members], ids[members], copies[members]
    for at in range(0, asking, BLOCK):
        end = min(at + BLOCK, asking)
        near = (x[at:end] @ xm.T >= cosine) & (ids[at:end, None] != im)
        others[at:end] = near @ cm
        for p in np.nonzero(near.any(1))[0]:
            hits = members[near[p]]
            p += at
            for r in np.unique(tree[hits[tree[hits] != tree[p]]]):
                forest.append((int(ids[p]), int(ids[hits[tree[hits] == r][0]])))
                tree[tree == r] = tree[p]
    return others, forest


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    common.small_batches(spark)

    def clean(batches):
        import pyarrow as pa

        for b in batches:
            units = [unit(v) for v in b.column(1).to_pylist()]
            flat = [None if u is None else u.tolist() for u in units]
            digest = [None if u is None else digest_of(u) for u in units]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(flat, pa.list_(pa.float64())), pa.array(digest, pa.binary())], ["id", "label", "x", "digest"])

    src = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].cast("array<double>").alias("v"), vectors[label_col].cast("string").alias("label"))
    rows = common.written(src.mapInArrow(clean, "id long, label string, x array<double>, digest binary"), "vectors")
    usable = rows.where("id IS NOT NULL AND label IS NOT NULL AND digest IS NOT NULL")
    # vectors are known by their label and content: one id may have several
    classes = usable.groupBy("label", "digest").agg(F.min("id").alias("low"), F.count_distinct("id").alias("copies"))
    classes = common.written(classes.withColumn("number", F.monotonically_increasing_id()), "vector-classes")
    reps = usable.withColumnRenamed("id", "low").join(classes, ["label", "digest", "low"]).dropDuplicates(["number"]).select(F.col("number").alias("id"), "label", "x", F.size("x").alias("dim"), "copies")
    reps = common.written(reps, "vector-reps")

    # one row per (label, dimension): how many vectors, hence how many centres
    total = reps.count()
    share = min(1.0, MAX_CENTRES / max(1, -(-total // PER_CENTRE)))
    picked = reps.where((F.pmod(F.xxhash64("id", "label"), F.lit(1_000_000)) < F.lit(1_000_000 * share / PER_CENTRE))).limit(4 * MAX_CENTRES).collect()
    centres: dict[tuple, np.ndarray] = {}
    for key in {(r["label"], r["dim"]) for r in picked}:
        centres[key] = np.array([r["x"] for r in picked if (r["label"], r["dim"]) == key])
    held = spark.sparkContext.broadcast(centres)  # at most 4 * MAX_CENTRES vectors

    # a vector within the angle of x is nearest to a centre c only if x is within that angle of the plane between c and its own centre
    margin = (np.sqrt(max(0.0, 1 - cosine * cosine)) if cosine > 0 else np.inf) + 1e-9

    def assign(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for i, label, x, dim, copies in zip(*(c.to_pylist() for c in b.columns), strict=True):
                c, home, shards = held.value.get((label, dim)), 0, [0]
                if c is not None and len(c) > 1:
                    near = c @ np.array(x)
                    home = int(near.argmax())
                    apart = np.sqrt(np.maximum(0.0, ((c - c[home]) ** 2).sum(1)))
                    shards = np.nonzero(near[home] - near <= margin * apart + 1e-12)[0].tolist()
                out += [(i, label, f"{dim}:{s}", x, copies, s == home) for s in shards]
            if out:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "label", "shard", "x", "copies", "home"])

    sharded = common.written(reps.mapInArrow(assign, "id long, label string, shard string, x array<double>, copies long, home boolean"), "shards")
    # members of a shard in k slices, all rows that look there in m: a task has one slice of each, so none outgrows memory
    size = lambda rows: F.greatest(F.lit(1), F.ceil(rows / (8 * PER_CENTRE))).cast("int")
    sizes = sharded.groupBy("label", "shard").agg(size(F.sum(F.col("home").cast("int"))).alias("k"), size(F.count("*")).alias("m"))
    spread = sharded.join(F.broadcast(sizes) if share == 1.0 and len(picked) < MAX_CENTRES else sizes, ["label", "shard"])
    spread = spread.withColumn("i", F.pmod(F.xxhash64("id"), "k").cast("int")).withColumn("j", F.pmod(F.xxhash64("id", F.lit(1)), "m").cast("int"))
    asks = "transform(sequence(0, k - 1), s -> struct(s AS i, j AS j, home AND s = i AS member, true AS asks))"
    holds = "filter(transform(sequence(0, m - 1), s -> struct(i AS i, s AS j, true AS member, false AS asks)), c -> home AND c.j <> j)"
    spread = spread.withColumn("cell", F.explode(F.expr(f"concat({asks}, {holds})"))).select("label", "shard", "cell.*", "id", "x", "copies")

    def search(pdf):
        import pandas as pd

        pdf = pdf.sort_values("asks", ascending=False, kind="stable")
        ids, n = pdf["id"].to_numpy(np.int64), int(pdf["asks"].sum())
        others, forest = scan(np.array(pdf["x"].tolist()), ids, pdf["copies"].to_numpy(np.int64), np.nonzero(pdf["member"].to_numpy(bool))[0], cosine, n)
        some = np.nonzero(others)[0]
        a, b = np.array(forest, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"a": np.r_[ids[some], a], "b": np.r_[ids[some], b], "others": np.r_[others[some], np.zeros(len(a), np.int64)]}, dtype="int64")

    # every member is in one slice of one shard, so a link is counted once for each of its ends; at most two rows a row
    links = common.written(spread.groupBy("label", "shard", "i", "j").applyInPandas(search, "a long, b long, others long"), "vector-links")
    degree = links.groupBy(F.col("a").alias("number")).agg(F.sum("others").alias("others"))
    links = links.where("a <> b").select("a", "b")
    comp = common.components(links).select(F.col("id").alias("number"), F.col("component_id").alias("root"))
    info = classes.join(degree, "number", "left").join(comp, "number", "left").withColumn("root", F.coalesce("root", "number"))
    lowest = info.groupBy("root").agg(F.min("low").alias("component_id"))
    info = info.join(lowest, "root").select("label", "digest", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "label", "digest").join(info, ["label", "digest"], "left")
    bad = F.col("id").isNull()
    component = F.when(bad, None).otherwise(F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.when(bad, 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact number of links of the rows in ``exact`` (vec_id, n_links) that ``found`` has."""
    r = exact.select("vec_id", F.col("n_links").alias("all")).join(found, "vec_id").agg(F.sum("n_links"), F.sum("all")).first()
    return 1.0 if not r[1] else float(r[0]) / float(r[1])


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(common.read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))

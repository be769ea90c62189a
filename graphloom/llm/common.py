"""What several operators share: table access, shared storage, words, classes."""

from __future__ import annotations

import gc
import re
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: texts may be long, so batches stay small.
ARROW_ROWS = 1000

#: The six ASCII white-space characters of the word pattern [^\x20\x09-\x0D]+.
BLANKS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def small_batches(spark: SparkSession) -> None:
    """Bound the rows that a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset a temporary folder is set, on one machine only: elsewhere
    executors would not share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="graphloom-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/graphloom-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it back.

    A lost executor then costs a read, never a recomputation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*tables: DataFrame | None) -> None:
    """Remove tables that :func:`written` returned, once nothing reads them any more."""
    for df in tables:
        path = df is not None and getattr(df, "kept_at", None)
        if path:
            remove_path(df.sparkSession, path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def released(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files that no query needs any more.

    It does so when the driver collects its garbage, which may be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean() -> None:
    """Give back what earlier tasks left in this Python worker, which Spark reuses for other queries.

    These are the tables of tokens (some 190 MB a worker) and freed memory that
    the allocator holds.  Tasks that do not encode texts begin with it.
    """
    if (bpe := sys.modules.get(f"{__package__}.bpe")) is not None:
        bpe.forget()
    trimmed()


def trimmed() -> None:
    """Give freed memory back that the allocator holds."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


class Forest:
    """Union-find over the ids of a task, bounded: beyond ``limit`` ids it starts anew."""

    def __init__(self, limit: int = 1_000_000):
        self.parent: dict[int, int] = {}
        self.limit = limit

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the edge joins two trees; a forest begun anew only repeats edges."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if len(self.parent) >= self.limit:
            self.parent.clear()
        self.parent[max(a, b)] = min(a, b)
        return True


def thinned(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of each task without those that its others imply."""

    def thin(batches):
        import pyarrow as pa

        trees = Forest()
        for b in batches:
            new = [(u, v) for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True) if trees.join(u, v)]
            if new:
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in new], pa.int64()), pa.array([v for _, v in new], pa.int64())], ["u", "v"])

    return edges.mapInArrow(thin, "u long, v long")


#: Edges that one task labels at once (some 200 MB); more are worked off by rounds of joins, to the same result.
TASK_EDGES = 2_000_000


def labelled(u, v):
    """Ids and their smallest reachable ids, by hooking roots and pointer jumping over arrays of edges."""
    import numpy as np

    ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    parent = np.arange(len(ids))
    while True:
        x, y = parent[a], parent[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low != high
        if not apart.any():
            return ids, ids[parent]
        np.minimum.at(parent, high[apart], low[apart])
        while True:  # roots only point to smaller roots
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def components(pairs: DataFrame, a: str = "a", b: str = "b", task_edges: int | None = None) -> DataFrame:
    """Smallest reachable id of every id that occurs in ``pairs``.

    Each task first drops edges that its others imply.  What is left is labelled
    in one task if it is at most ``TASK_EDGES`` edges; else large-star and
    small-star steps (Kiveris et al., "Connected Components in MapReduce and
    Beyond") alternate until the edges stop changing; the number of rounds grows
    with the logarithm of a component's size.  Edges are written after every
    round, so lineage stays short.  A node's neighbours meet only in aggregates
    (``min``), never in one list.

    Returns (id, component_id), the smallest id of a component included.
    """
    spark = pairs.sparkSession
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = thinned(edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")))
    edges = written(thinned(edges.distinct()), "edges")
    if edges.count() <= (TASK_EDGES if task_edges is None else task_edges):

        def solve(batches):
            import numpy as np
            import pyarrow as pa

            cols = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
            if cols:
                ids, low = labelled(np.concatenate([x for x, _ in cols]), np.concatenate([y for _, y in cols]))
                for k in range(0, len(ids), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 100_000]), pa.array(low[k : k + 100_000])], ["id", "component_id"])

        out = written(edges.coalesce(1).mapInArrow(solve, "id long, component_id long"), "components")
        dropped(edges)
        return out
    return _by_stars(edges)


def _by_stars(edges: DataFrame) -> DataFrame:
    state = None
    while True:
        # large star: larger neighbours of every node point to its smallest one
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours (and the node) point to the smallest
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low2.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, "edges")
        dropped(edges)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(now):
            break
        state = tuple(now)
    labels = edges.groupBy("u").agg(F.min("v").alias("component_id")).select(F.col("u").alias("id"), "component_id")
    roots = edges.select(F.col("v").alias("id")).distinct().join(edges.select(F.col("u").alias("id")), "id", "left_anti")
    return labels.union(roots.select("id", F.col("id").alias("component_id")))

"""The property graph projected from relational tables.

``nodes(id, kind, name, qualified_name, file)`` and ``edges(kind, src, dst)``.
An id is a type number times ``SPAN`` plus the key of the row.
"""

from __future__ import annotations

import contextlib
import contextvars
import re
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPAN = 10_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ident(kind: int, key: str) -> Column:
    return F.lit(kind * SPAN) + F.col(key).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one machine alone may use a temporary one."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
    sc.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="graphloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


class Stopped(RuntimeError):
    """Work that was cancelled or ran out of time."""


class Scope:
    """Work of this thread that can be cancelled, from any thread, and may have a deadline in seconds.

    ``with Scope(spark, 30) as s: ...`` tags the jobs started inside.  ``cancel``
    interrupts those that run; the next round of an iterative operator ends with
    :class:`Stopped`.  Intermediate tables lie in one folder: it is removed on the
    way out of work that failed or was stopped; after success it stays, as results
    may still be read from it, until ``drop``.
    """

    def __init__(self, spark: SparkSession, seconds: float | None = None):
        self.spark, self.seconds, self.why = spark, seconds, None
        self.tag, self.folder, self.tables = f"graphloom-{uuid.uuid4().hex}", fresh_path(spark, "scope"), 0

    def cancel(self, why: str = "cancelled") -> None:
        self.why = self.why or why
        self.spark.sparkContext.cancelJobsWithTag(self.tag)  # a session's own interruptTag knows the tags of the calling thread only

    def check(self) -> None:
        if self.why:
            raise Stopped(self.why)

    def written(self, df: DataFrame) -> DataFrame:
        self.check()
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        df.write.parquet(path)
        self.check()
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        remove_path(self.spark, self.folder)

    def __enter__(self) -> Scope:
        self._timer = None
        if self.seconds is not None:
            self._timer = threading.Timer(self.seconds, self.cancel, (f"no end within {self.seconds} seconds",))
            self._timer.daemon = True
            self._timer.start()
        sc = self.spark.sparkContext
        sc.addJobTag(self.tag)
        sc.setInterruptOnCancel(True)
        self._before = _SCOPE.set(self)
        return self

    def __exit__(self, kind, error, trace) -> None:
        _SCOPE.reset(self._before)
        sc = self.spark.sparkContext
        sc.removeJobTag(self.tag)
        sc.setInterruptOnCancel(False)
        if self._timer:
            self._timer.cancel()
        if error is not None:
            self.drop()
            if self.why and not isinstance(error, Stopped):
                raise Stopped(self.why) from error


_SCOPE: contextvars.ContextVar[Scope | None] = contextvars.ContextVar("scope", default=None)
_PASSING: contextvars.ContextVar[list | None] = contextvars.ContextVar("passing", default=None)


def cut(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; in a :class:`Scope`, with a table in its folder.

    What outlives a scope is ``lasting``.
    """
    scope = _SCOPE.get()
    if scope is not None:
        scope.check()
        if not lasting:
            return scope.written(df)
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that are always shuffled.

    Sizes estimated from compressed files, or kept through a cut, make tables of
    millions of rows look small enough for a broadcast, which the driver holds.
    """
    return df.hint("merge")


def dealt(df: DataFrame) -> DataFrame:
    """:func:`renewed`, then :func:`spread`; a table of columns takes a fraction of the bytes of a checkpoint of rows."""
    kept = renewed(df)
    out = spread(kept)
    out.kept_at = kept.kept_at
    return out


def held(df: DataFrame) -> DataFrame:
    """``df`` if :func:`dealt` made it, else a table of it."""
    return df if getattr(df, "kept_at", None) else dealt(df)


@contextlib.contextmanager
def passing(spark: SparkSession):
    """The tables that :func:`dealt` and :func:`renewed` make inside are removed on the way out; nothing may read them later."""
    before = _PASSING.set([])
    try:
        yield
    finally:
        made = _PASSING.get()
        _PASSING.reset(before)
        for path in made:
            remove_path(spark, path)


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/graphloom-{what}-{uuid.uuid4().hex}"


def renewed(df: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Cut the lineage with a table in the shared folder; ``before``, an earlier table of this kind that it supersedes, is removed.

    An iterative operator thus keeps the tables of one round, however many rounds there are.
    """
    scope, spark = _SCOPE.get(), df.sparkSession
    if scope is not None:
        out, path = scope.written(df), f"{scope.folder}/{scope.tables}"
    else:
        path = fresh_path(spark, "round")
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    made = _PASSING.get()
    if made is not None:
        made.append(path)
    superseded(before)
    return out


def superseded(df: DataFrame | None) -> None:
    """Remove a table of :func:`renewed` that nothing reads any more; other tables stay."""
    path = df is not None and getattr(df, "kept_at", None)
    if path:
        remove_path(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation")
    home = nation.select("n_nationkey", F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit("/")).alias("dir"))
    c = t("customer").join(home, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("file", F.concat("dir", F.lower("c_mktsegment"), F.lit(".rs")))
    s = t("supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("file", F.concat("dir", F.lit("supply.rs")))
    n = nation.join(home, "n_nationkey").withColumn("file", F.concat("dir", F.lit("supply.rs")))
    o = t("orders").join(c.select("c_custkey", "c_name", "file"), F.col("o_custkey") == F.col("c_custkey")).withColumn("name", F.concat(F.lit("o"), "o_orderkey"))
    row = lambda df, k, kind, key, name, q, file: df.select(ident(k, key).alias("id"), F.lit(kind).alias("kind"), F.expr(name).alias("name"), F.expr(q).alias("qualified_name"), F.expr(file).alias("file"))
    parts = [
        row(t("region"), 1, "Package", "r_regionkey", "r_name", "r_name", "concat('r', r_regionkey, '/package.rs')"),
        row(n, 2, "Module", "n_nationkey", "n_name", "n_name", "file"),
        row(c, 3, "Class", "c_custkey", "c_name", "c_name", "file"),
        row(s, 4, "Interface", "s_suppkey", "s_name", "s_name", "file"),
        row(t("part"), 5, "Function", "p_partkey", "p_name", "p_name", "concat('parts/', replace(lower(p_brand), '#', '_'), '.rs')"),
        row(o, 6, "Method", "o_orderkey", "name", "concat(c_name, '::', name)", "file"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, References, Instantiates and Implements; multi-edges are kept for Calls.

    Implements grows with customers times suppliers: customers are dealt over all
    partitions first, or the few tasks that read them would make all its rows.
    """
    t = lambda n: table(spark, sf_dir, n)
    li = t("lineitem")
    edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), a.alias("src"), b.alias("dst"))
    calls = edge(li, "Calls", ident(6, "l_orderkey"), ident(5, "l_partkey"))
    refs = edge(li.select("l_orderkey", "l_suppkey").distinct(), "References", ident(6, "l_orderkey"), ident(4, "l_suppkey"))
    made = edge(t("orders"), "Instantiates", ident(3, "o_custkey"), ident(6, "o_orderkey"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = t("customer").select("c_custkey", "c_nationkey").repartition(width, "c_custkey").join(F.broadcast(t("supplier").select("s_suppkey", "s_nationkey")), (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("c_custkey") % 100 == F.col("s_suppkey") % 100))
    return calls.unionByName(refs).unionByName(made).unionByName(edge(both, "Implements", ident(3, "c_custkey"), ident(4, "s_suppkey")))


def trade(spark: SparkSession, sf_dir: str, last_order: int | None = 40) -> DataFrame:
    """Nation graph (src, dst): who buys from whom, without loops; in the orders up to ``last_order``, or in all of them."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    if last_order is not None:
        li, o = li.where(F.col("l_orderkey") <= last_order), o.where(F.col("o_orderkey") <= last_order)
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).where("src <> dst").distinct()


def file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File nodes of every nation: its supply file and one file a market segment."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    segments = customer.select(F.lower("c_mktsegment").alias("segment")).distinct()
    names = segments.withColumn("no", F.row_number().over(Window.orderBy("segment"))).union(spark.createDataFrame([("supply", 0)], "segment string, no int"))
    path = F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit("/"), "segment", F.lit(".rs"))
    out = nation.join(names, F.lit(True)).select((F.lit(9 * SPAN) + F.col("n_nationkey") * 100 + F.col("no")).alias("id"), path.alias("file"))  # nations by a handful of segments
    return out.select("id", F.lit("File").alias("kind"), F.col("file").alias("name"), F.col("file").alias("qualified_name"), "file")


def whole_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).unionByName(file_nodes(spark, sf_dir))


def whole_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds: those of :func:`edges`, Contains from files to members, Imports between nations of large trades."""
    members = nodes(spark, sf_dir).select("file", F.col("id").alias("dst"))
    contains = members.join(file_nodes(spark, sf_dir).select("file", F.col("id").alias("src")), "file").select(F.lit("Contains").alias("kind"), "src", "dst")
    li, o = table(spark, sf_dir, "lineitem").where("l_quantity >= 49"), table(spark, sf_dir, "orders")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    imports = j.select(ident(2, "c_nationkey").alias("src"), ident(2, "s_nationkey").alias("dst")).distinct().select(F.lit("Imports").alias("kind"), "src", "dst")
    return edges(spark, sf_dir).unionByName(contains).unionByName(imports)

"""Bursts of file changes, coalesced actions, renames, and snapshots kept by a stream.

All of it works on batch and on streaming frames alike; a stream needs the
watermark that ``delay`` sets, and a burst is given out once the watermark has
passed its end.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUEUE = 1_000


def bursts(changes: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(path, started, changes) of every burst; changes are (path, ts)."""
    src = changes.withWatermark("ts", delay) if changes.isStreaming else changes
    out = src.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("changes"), F.min("ts").alias("started"))
    return out.select("path", "started", "changes")


def coalesced(kinds: Column) -> Column:
    """What a sequence of changes of one path comes to, null for nothing.

    create + modify = create, create + remove = nothing, remove + create = modify,
    modify + remove = remove, else the last.
    """

    def step(a: Column, k: Column) -> Column:
        return (
            F.when(a.isNull(), k)
            .when((a == "create") & (k == "modify"), "create")
            .when((a == "create") & (k == "remove"), None)
            .when((a == "remove") & (k == "create"), "modify")
            .otherwise(k)
        )

    return F.aggregate(kinds, F.lit(None).cast("string"), step)


def actions(changes: DataFrame, gap: str = "100 milliseconds", delay: str = "1 second") -> DataFrame:
    """(path, kind, last_seen): one action per path and quiet period; changes are (path, kind, ts).

    A burst is one path's changes without a pause, so its list is short.
    """
    src = changes.withWatermark("ts", delay) if changes.isStreaming else changes
    out = src.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.array_sort(F.collect_list(F.struct("ts", "kind"))).alias("all"), F.max("ts").alias("last_seen"))
    return out.select("path", coalesced(F.transform("all", lambda x: x["kind"])).alias("kind"), "last_seen").where("kind IS NOT NULL")


def checked(found: DataFrame, existing: DataFrame) -> DataFrame:
    """A modification of a file that is not among ``existing`` (path) is a removal."""
    there = existing.select("path", F.lit(True).alias("there")).distinct()
    j = found.join(there, "path", "left")
    return j.withColumn("kind", F.when((F.col("kind") == "modify") & F.col("there").isNull(), "remove").otherwise(F.col("kind"))).drop("there")


def renames(found: DataFrame) -> DataFrame:
    """(kind, path, old_path): the i-th rename_from with the i-th rename_to, by time and path; leftovers are removals and creations.

    ``found`` is what one flush gives out, at most a queue of actions.
    """
    w = Window.partitionBy("kind").orderBy("last_seen", "path")
    ends = found.where("kind IN ('rename_from', 'rename_to')").withColumn("n", F.row_number().over(w))
    a = ends.where("kind = 'rename_from'").select("n", F.col("path").alias("old_path"))
    b = ends.where("kind = 'rename_to'").select("n", "path")
    j = a.join(b, "n", "full_outer")
    kind = F.when(F.col("old_path").isNull(), "create").when(F.col("path").isNull(), "remove").otherwise("rename")
    paired = j.select(kind.alias("kind"), F.coalesce("path", "old_path").alias("path"), F.when(kind == "rename", F.col("old_path")).alias("old_path"))
    return found.where("kind NOT IN ('rename_from', 'rename_to')").select("kind", "path", F.lit(None).cast("string").alias("old_path")).union(paired)


class Snapshots:
    """Generations of tables in a shared folder: written whole, then published by one small pointer file.

    Readers hold the generation that they opened; a failed update leaves the last
    one in place.  A batch beyond the queue's capacity, or an error, asks for a
    full rebuild.
    """

    def __init__(self, spark: SparkSession, folder: str, capacity: int = QUEUE):
        self.spark, self.folder, self.capacity = spark, folder.rstrip("/"), capacity
        self.health, self.reason = "Healthy", None

    def _path(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def status(self) -> dict:
        p, files = self._path("status.json")
        if not files.exists(p):
            return {"generation": 0}
        return json.loads(self.spark.read.text(f"{self.folder}/status.json").first()[0])

    def tables(self) -> dict[str, DataFrame]:
        now = self.status()
        return {n: self.spark.read.parquet(f"{self.folder}/gen={now['generation']}/{n}") for n in now.get("tables", [])}

    def publish(self, tables: dict[str, DataFrame]) -> int:
        generation = self.status()["generation"] + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/gen={generation}/{name}")
        doc = {"generation": generation, "tables": sorted(tables), "health": self.health, "reason": self.reason, "time_ms": int(time.time() * 1000)}
        new, files = self._path("status.json.new")
        out = files.create(new, True)
        out.write(bytearray(json.dumps(doc).encode()))
        out.close()
        old, _ = self._path("status.json")
        if files.exists(old):
            files.delete(old, False)
        files.rename(new, old)
        return generation

    def on_batch(self, update, rebuild):
        """For ``foreachBatch``: ``update(tables, actions)`` or, beyond the capacity or after an error, ``rebuild()`` gives new tables."""

        def run(batch: DataFrame, _: int) -> None:
            batch.persist()
            try:
                if batch.isEmpty():
                    return
                too_many = batch.limit(self.capacity + 1).count() > self.capacity
                self.health, self.reason = ("Recovering", "queue overflow") if too_many else ("Updating", None)
                try:
                    tables = rebuild() if too_many else update(self.tables(), batch)
                except Exception as e:  # the last generation stays; a full rebuild follows
                    self.health, self.reason = "Recovering", str(e)[:200]
                    tables = rebuild()
                self.health = "Healthy"
                self.publish(tables)
            except Exception as e:
                self.health, self.reason = "Failed", str(e)[:200]
            finally:
                batch.unpersist()

        return run

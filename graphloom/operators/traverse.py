"""Frontier joins: reachability, impact, components, PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut, renewed, superseded


#: A front of at most that many nodes is a condition on edges instead of a side of their join.
FEW = 1000


def among(rows: DataFrame, column: str, front: DataFrame) -> DataFrame:
    """``rows`` for a join of ``column`` with the ids of ``front`` (id): with few of them, those that can meet one.

    The condition is pushed into what the rows are made of, so that a step from a
    small front reads the tables but makes, shuffles and joins no other edges.
    """
    ids = [r[0] for r in front.select("id").distinct().limit(FEW + 1).collect()]  # bounded
    return rows.where(F.col(column).isin(ids)) if len(ids) <= FEW else rows


def levels(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(id, depth): hops from the nearest of ``seeds`` (id), at most ``depth``."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = edges.select(F.col(a).alias("id"), F.col(b).alias("next"))
    seen = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0).cast("long")))
    front = seen
    for d in range(1, depth + 1):
        front = cut(front.select("id").join(among(step, "id", front), "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(d).cast("long")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component_id, size) by colouring: forward colours, backward sweeps, repeated on what is left."""
    left = cut(edges.select("src", "dst").distinct())
    every = cut(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct())
    done = None
    todo = every
    while not todo.isEmpty():
        colour = todo.select("id", F.col("id").alias("c"))
        before = None
        while True:  # smallest id that reaches a node
            incoming = left.join(colour.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "c")
            colour = renewed(colour.union(incoming).groupBy("id").agg(F.min("c").alias("c")), colour)
            now = colour.agg(F.sum(F.xxhash64("id", "c").cast("decimal(38,0)"))).first()[0]
            if now == before:
                break
            before = now
        same = left.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        same = cut(same.select("src", "dst", F.col("cs").alias("c")))
        mine = front = renewed(colour.where("id = c"), colour)
        while not front.isEmpty():  # nodes of a colour that reach its root
            reach = same.join(front.select(F.col("id").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct()
            front = renewed(reach.join(mine, ["id", "c"], "left_anti"), None if front is mine else front)
            mine = renewed(mine.union(front), mine)
        superseded(front)
        done = mine if done is None else done.union(mine)
        todo = cut(todo.join(mine, "id", "left_anti"))
        left = cut(left.join(mine.select(F.col("id").alias("src")), "src", "left_anti").join(mine.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
    if done is None:
        return every.select("id", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("size"))
    size = done.groupBy("c").agg(F.count("*").alias("size"))
    return done.join(size, "c").select("id", F.col("c").alias("component_id"), "size")


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, ids: DataFrame | None = None) -> DataFrame:
    """(id, rank) over weighted edges (src, dst, weight); dangling mass is spread evenly.

    ``ids`` (id) names all nodes, by default those that edges touch.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    ids = (share.select(F.col("src").alias("id")).union(share.select("dst")) if ids is None else ids).distinct()
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    ranks = cut(ids.join(out.select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left").select("id", F.coalesce("dangling", F.lit(True)).alias("dangling"), F.lit(1.0 / n).alias("rank")))
    new = None
    for _ in range(rounds):
        lost = ranks.where("dangling").agg(F.sum("rank")).first()[0] or 0.0
        got = share.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        new = renewed(ranks.withColumnRenamed("rank", "old").join(got, "id", "left").select("id", "dangling", "old", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)).alias("rank")), new)
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = new.drop("old")
        if moved < tolerance:
            break
    return ranks.select("id", "rank")

"""Lookups, projections, aggregates, history and differences as plain plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import looks_like_test
from ..functions.text import parent_module, relevance
from .compare import often
from .graphs import keyed


def find(nodes: DataFrame, term: str) -> DataFrame:
    """Exact qualified name, name or file; only if there is none, substrings of names."""
    if not term:
        return nodes.limit(0)
    exact = nodes.where((F.col("qualified_name") == term) | (F.col("name") == term) | (F.col("file") == term))
    loose = nodes.where(F.col("name").contains(term) | F.col("qualified_name").contains(term))
    none = exact.agg(F.count("*").alias("hits")).where("hits = 0")
    return exact.unionByName(loose.join(F.broadcast(none), F.lit(True)).drop("hits"))  # one row at most is broadcast


def search(nodes: DataFrame, term: str, limit: int) -> DataFrame:
    """The best by lexical score; a blank term finds nothing."""
    if not term.strip():
        return nodes.limit(0).withColumn("score", F.lit(0).cast("long"))
    scored = nodes.withColumn("score", relevance(F.col("name"), F.col("qualified_name"), F.col("file"), term)).where("score > 0")
    return scored.orderBy(F.desc("score"), "qualified_name", "id").limit(limit)


def histogram(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def project(nodes: DataFrame, edges: DataFrame, level: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, member_count) and edges (src, dst, weight, kinds) of the file or module level; loops stay."""
    key = F.col("file") if level == "file" else parent_module(F.col("file"))
    of = nodes.select("id", key.alias("key"))
    p_nodes = of.groupBy(F.col("key").alias("id")).agg(F.count("*").alias("member_count"))
    e = edges.join(keyed(of, "src", "a"), "src").join(keyed(of, "dst", "b"), "dst")
    per = e.groupBy(F.col("a").alias("src"), F.col("b").alias("dst"), "kind").agg(F.count("*").alias("n"))  # hashed; a set of kinds would sort all edges
    p_edges = per.groupBy("src", "dst").agg(F.sum("n").alias("weight"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return p_nodes, p_edges


def coupling(p_nodes: DataFrame, p_edges: DataFrame) -> DataFrame:
    """Afferent and efferent coupling over distinct neighbours, and instability."""
    out = p_edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("efferent"))
    inn = p_edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("afferent"))
    j = p_nodes.select("id").join(inn, "id", "left").join(out, "id", "left").na.fill(0)
    total = F.col("afferent") + F.col("efferent")
    return j.withColumn("instability", F.when(total == 0, 0.0).otherwise(F.round(F.col("efferent") / total, 6)))


def churn(commits: DataFrame) -> DataFrame:
    """Commits and distinct authors of every file; commits are (commit, author, file) rows."""
    return commits.groupBy("file").agg(F.count_distinct("commit").alias("commits"), F.count_distinct("author").alias("authors"))


def change_coupling(commits: DataFrame, min_support: float) -> DataFrame:
    """Pairs of files a < b that change together in enough of all commits."""
    c = commits.select("commit", "file").distinct()
    total = c.agg(F.count_distinct("commit").alias("total"))
    n = c.groupBy("file").agg(F.count("*").alias("n"))
    some = c.join(often(n, total, min_support).select("file"), "file", "left_semi")  # no pair is found more often than either file
    pairs = some.alias("x").join(some.alias("y"), "commit").where("x.file < y.file").groupBy(F.col("x.file").alias("file_a"), F.col("y.file").alias("file_b")).agg(F.count("*").alias("co_commits"))
    pairs = pairs.join(F.broadcast(total), F.col("co_commits") >= min_support * F.col("total")).drop("total")
    out = pairs.join(n.select(F.col("file").alias("file_a"), F.col("n").alias("na")), "file_a").join(n.select(F.col("file").alias("file_b"), F.col("n").alias("nb")), "file_b")
    return out.select("file_a", "file_b", "co_commits", F.round(F.col("co_commits") / F.col("na"), 6).alias("conf_a_b"), F.round(F.col("co_commits") / F.col("nb"), 6).alias("conf_b_a"))


def dead_code(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Nodes of the kinds that no edge points to."""
    return nodes.where(F.col("kind").isin(*kinds)).join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def unreferenced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Dead-code candidates: no inbound edge but Contains; files, modules, main and what looks like a test left out."""
    some = nodes.where(~F.col("kind").isin("File", "Module") & (F.col("name") != "main") & ~looks_like_test(F.col("name"), F.col("file")))
    return some.join(edges.where("kind <> 'Contains'").select(F.col("dst").alias("id")).distinct().hint("shuffle_hash"), "id", "left_anti")  # ids are held, nodes are not sorted


def edge_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges added and removed by (kind, src, dst), multi-rows kept."""
    keys = ["kind", "src", "dst"]
    on = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    added = new.join(old, on(new, old), "left_anti").withColumn("change", F.lit("added"))
    removed = old.join(new, on(old, new), "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def overloads(nodes: DataFrame) -> DataFrame:
    """Running number of nodes that share file, name and kind."""
    w = Window.partitionBy("file", "name", "kind").orderBy("qualified_name", "id")
    return nodes.withColumn("overload", F.row_number().over(w).cast("long") - 1)


def unenclosed(spans: DataFrame) -> DataFrame:
    """Spans (file, start, end, id) that no span before them in the order start, -end, id covers."""
    w = Window.partitionBy("file").orderBy("start", F.desc("end"), "id").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("__max", F.max("end").over(w)).where("__max IS NULL OR __max < end").drop("__max")


def dot_lines(p_edges: DataFrame) -> DataFrame:
    esc = lambda c: F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return p_edges.select(F.concat(F.lit('"'), esc("src"), F.lit('" -> "'), esc("dst"), F.lit('" [label="'), "kinds", F.lit('"];')).alias("line"))

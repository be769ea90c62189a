"""Projections to three levels and the analyses on them: degrees, hotspots, cycles, communities, paths, impact.

Nodes are (id, kind, name, qualified_name, file, ...), edges (kind, src, dst, ...).
Loops over rounds end on one small aggregate a round; tables between rounds are
checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions.text import parent_module
from ..sources.tables import cut, renewed, superseded
from . import ranks
from .traverse import among


def edge_filter(edges: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Edges of the kinds; without kinds all but Contains."""
    return edges.where(F.col("kind").isin(*kinds)) if kinds else edges.where("kind <> 'Contains'")


def symbol_keys(nodes: DataFrame) -> DataFrame:
    """(id, key, name): symbols by qualified name, with ``#id`` behind those that share it; files only if there is nothing else."""
    symbols = nodes.where("kind <> 'File'")
    any_symbol = symbols.limit(1).agg(F.count("*").alias("some"))
    of = nodes.join(F.broadcast(any_symbol), F.lit(True)).where("kind <> 'File' OR some = 0")  # one row is broadcast
    named = of.withColumn("times", F.count("*").over(Window.partitionBy("qualified_name")))
    key = F.when(F.col("times") > 1, F.concat("qualified_name", F.lit("#"), S.unsigned(F.col("id")).cast("string"))).otherwise(F.col("qualified_name"))
    named = named.select("id", key.alias("key"), "name")
    taken = Window.partitionBy("key").orderBy("id")  # a literal name may look like a made one
    return named.withColumn("n", F.row_number().over(taken)).select("id", F.when(F.col("n") > 1, F.concat("key", F.lit("#"), F.col("n").cast("string"))).otherwise(F.col("key")).alias("key"), "name")


def level_keys(nodes: DataFrame, level: str) -> DataFrame:
    """(id, key, name) of every node at a level."""
    if level == "symbol":
        return symbol_keys(nodes)
    file = F.when(F.col("file") == "", F.col("name")).otherwise(F.col("file"))
    key = file if level == "file" else parent_module(file)
    return nodes.select("id", key.alias("key"), key.alias("name"))


def projected(nodes: DataFrame, edges: DataFrame, level: str, kinds: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """p_nodes (id, name, level, member_count) and p_edges (src, dst, weight, kinds); loops stay.

    Edges stream through hash tables of their ends, one row a node, and are summed
    once both keys are known: a task holds nodes and projected pairs, not edges.
    The kinds of a pair are bits of a number.
    """
    of = level_keys(nodes, level)
    p_nodes = of.groupBy(F.col("key").alias("id")).agg(F.min("name").alias("name"), F.count("*").alias("member_count")).select("id", "name", F.lit(level).alias("level"), "member_count")
    some = edge_filter(edges, kinds).select("src", "dst", "kind")
    ends = some.join(keyed(of, "src", "a"), "src").join(keyed(of, "dst", "b"), "dst")
    code, pair = S.code(F.col("kind"), S.EDGE_KINDS), (F.col("a").alias("src"), F.col("b").alias("dst"))
    per = ends.groupBy(*pair).agg(F.count("*").alias("weight"), F.bit_or(F.call_function("shiftleft", F.lit(1), code)).alias("bits"))
    # kinds that the list does not have come first, as their code is 0
    others = ends.where(code == 0).groupBy(*pair).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("others"))
    names = F.concat_ws(",", "others", *(F.when(F.col("bits").bitwiseAND(F.lit(1 << k)) > 0, kind) for k, kind in enumerate(S.EDGE_KINDS, 1)))
    return p_nodes, per.join(others, ["src", "dst"], "left").select("src", "dst", "weight", names.alias("kinds"))


def keyed(keys: DataFrame, end: str, name: str) -> DataFrame:
    """Keys (id, key) of one end of edges, as the side of a join that is held in hash tables."""
    return keys.select(F.col("id").alias(end), F.col("key").alias(name)).hint("shuffle_hash")


def adjacency(p_nodes: DataFrame, p_edges: DataFrame) -> DataFrame:
    """(idx, id, neighbour): dense numbers in the order of id, one row per neighbour (null if there is none)."""
    ordered = p_nodes.select("id").repartitionByRange("id").sortWithinPartitions("id")
    local = ordered.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33))
    local = cut(local)
    before = local.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # a row a partition
    idx = local.join(before, "part").select((F.col("at") + F.coalesce("before", F.lit(0))).alias("idx"), "id")
    to = p_edges.join(idx.select(F.col("id").alias("dst"), F.col("idx").alias("neighbour")), "dst").select(F.col("src").alias("id"), "neighbour")
    return idx.join(to, "id", "left").select("idx", "id", "neighbour")


def degrees(p_nodes: DataFrame, p_edges: DataFrame) -> DataFrame:
    """Distinct projected neighbours: (id, in_degree, out_degree, total_degree)."""
    out = p_edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    inn = p_edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    j = p_nodes.select("id").join(inn, "id", "left").join(out, "id", "left").na.fill(0, ["in_degree", "out_degree"])
    return j.select("id", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("total_degree"))


def shape(p_nodes: DataFrame, p_edges: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, self_loops."""
    return p_nodes.agg(F.count("*").alias("node_count")).join(p_edges.agg(F.count("*").alias("edge_count"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops")))


def component_ids(components: DataFrame, p_edges: DataFrame) -> DataFrame:
    """(id, number, size, trivial): numbers by size, then first member; a single node without a loop is trivial."""
    loops = p_edges.where("src = dst").select(F.col("src").alias("id")).distinct().withColumn("loop", F.lit(True))
    per = components.groupBy("component_id").agg(F.min("id").alias("first"), F.count("*").alias("size"))
    numbered = ranks.numbered(per, F.desc("size"), F.asc("first"))
    j = components.select("id", "component_id").join(numbered, "component_id").join(loops, "id", "left")
    return j.select("id", "number", "size", ((F.col("size") == 1) & F.col("loop").isNull()).alias("trivial"))


def hotspots(p_nodes: DataFrame, p_edges: DataFrame, ranks: DataFrame, components: DataFrame) -> DataFrame:
    """(2 fan-in + fan-out)(1 + 10 rank), times 1.5 + size / 10 inside a cycle; ranks (id, rank), components of :func:`component_ids`."""
    d = degrees(p_nodes, p_edges).join(ranks, "id", "left").join(components, "id", "left")
    in_scc = ~F.coalesce("trivial", F.lit(True))
    base = (2 * F.col("in_degree") + F.col("out_degree")) * (1 + 10 * F.coalesce("rank", F.lit(0.0)))
    score = base * F.when(in_scc, 1.5 + 0.1 * F.col("size")).otherwise(1.0)
    return d.select("id", F.col("in_degree").alias("fan_in"), F.col("out_degree").alias("fan_out"), in_scc.alias("in_scc"), score.alias("score"))


def cycles(p_edges: DataFrame, components: DataFrame, max_length: int = 20, max_cycles: int | None = 100, self_loops: bool = False) -> DataFrame:
    """Elementary cycles (path, length), each once, from its smallest member; ``components`` as of :func:`component_ids`.

    Paths grow inside a component, only to larger members than their start, and
    only where the start can still be reached within the length over such
    members.  A limit keeps the first in the order of length and path; the search
    ends with the level that fills it, as all longer cycles come after.
    """
    same = p_edges.join(components.where("NOT trivial").select(F.col("id").alias("src"), F.col("number").alias("a")), "src").join(components.select(F.col("id").alias("dst"), F.col("number").alias("b")), "dst").where("a = b")
    e = cut(same.select("src", "dst"))
    loops = e.where("src = dst").select(F.array("src").alias("path"), F.lit(1).cast("long").alias("length"))
    e = e.where("src <> dst").distinct()
    found = cut(loops if self_loops else loops.limit(0))
    back = returns(e, max_length - 1)
    paths = e.where("dst > src").select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"), F.col("src").alias("start"))
    for n in range(2, max_length + 1):
        # n nodes so far; the way home takes as many more as are left
        paths = cut(paths.join(back.select("start", F.col("node").alias("at"), "hops"), ["start", "at"]).where(F.col("hops") <= max_length - n + 1))
        if paths.isEmpty():
            break
        hit = paths.where("hops = 1").select("path", F.lit(n).cast("long").alias("length"))
        found = cut(found.union(hit))
        if n == max_length or (max_cycles is not None and found.count() >= max_cycles):
            break
        step = paths.select("path", "start", F.col("at").alias("src")).join(e, "src").where("dst > start AND NOT array_contains(path, dst)")
        paths = step.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"), "start")
    out = found.select(F.array_join(F.col("path").cast("array<string>"), " -> ").alias("path"), "length")
    return out.orderBy("length", "path").limit(max_cycles) if max_cycles is not None else out


def returns(e: DataFrame, most: int) -> DataFrame:
    """(start, node, hops): fewest edges from a node back to a smaller start over nodes larger than it, at most ``most``."""
    front = cut(e.where("src > dst").select(F.col("dst").alias("start"), F.col("src").alias("node"), F.lit(1).alias("hops")).distinct())
    every = front
    for h in range(2, most + 1):
        step = front.select("start", F.col("node").alias("dst")).join(e, "dst").where("src > start").select("start", F.col("src").alias("node")).distinct()
        front = cut(step.join(every, ["start", "node"], "left_anti").withColumn("hops", F.lit(h)))
        if front.isEmpty():
            break
        every = cut(every.union(front))
    return every


def cycle_kinds(found: DataFrame, p_edges: DataFrame) -> DataFrame:
    """(path, length, edge_kinds): of every step of a cycle the kinds of its projected edge; ``p_edges`` has ``kinds``."""
    nodes = F.split("path", " -> ")
    steps = found.select("path", "length", F.posexplode(F.arrays_zip(nodes.alias("a"), F.concat(F.slice(nodes, 2, F.size(nodes)), F.slice(nodes, 1, 1)).alias("b"))).alias("n", "step")).select("path", "length", "n", F.col("step.a").alias("src"), F.col("step.b").alias("dst"))
    kinds = p_edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "kinds")
    per = steps.join(kinds, ["src", "dst"]).groupBy("path", "length").agg(F.array_sort(F.collect_list(F.struct("n", "kinds"))).alias("s"))
    return per.select("path", "length", F.expr("transform(s, x -> x.kinds)").alias("edge_kinds"))


def communities(p_nodes: DataFrame, p_edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, label) by synchronous label propagation: summed weights both ways, a vote of one for the own label, ties to the smallest label.

    Without ``rounds`` it goes on until no label changes.  Votes are symmetric, so
    labels end in one state or in two that alternate; of two, the one after an even
    number of rounds counts, or the one that ``rounds`` would end with.
    """
    votes = p_edges.select(F.col("src").alias("id"), F.col("dst").alias("from"), "weight").union(p_edges.select("dst", "src", "weight")).union(p_nodes.select("id", "id", F.lit(1).cast("long")))
    votes = cut(votes.groupBy("id", "from").agg(F.sum("weight").alias("weight")))
    labels, before, n = renewed(p_nodes.select("id", F.col("id").alias("label"))), None, 0
    while rounds is None or n < rounds:
        n += 1
        counted = votes.join(labels.select(F.col("id").alias("from"), "label"), "from").groupBy("id", "label").agg(F.sum("weight").alias("w"))
        new = renewed(counted.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("best")).select("id", F.col("best.label").alias("label")))
        differ = lambda a, b: not a.join(b.withColumnRenamed("label", "old"), "id").where("label <> old").isEmpty()
        settled = not differ(new, labels)
        alternate = not settled and before is not None and not differ(new, before)
        superseded(before)
        before, labels = labels, new
        if settled or alternate:
            break
    if before is not None and n != (rounds or 0) and (n - (rounds or 0)) % 2:
        before, labels = labels, before  # equal if they have settled
    superseded(before)
    return labels


def community_report(labels: DataFrame, p_edges: DataFrame) -> DataFrame:
    """(number, label, size, internal_edges, external_edges): by size, then first member; edges are distinct projected ones."""
    ends = p_edges.join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    counts = ends.groupBy(F.col("a").alias("label")).agg(F.count_if(F.col("a") == F.col("b")).alias("internal_edges"), F.count_if(F.col("a") != F.col("b")).alias("external_edges"))
    per = labels.groupBy("label").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    numbered = ranks.numbered(per, F.desc("size"), F.asc("first"))
    return numbered.join(counts, "label", "left").na.fill(0, ["internal_edges", "external_edges"]).select("number", "label", "size", "internal_edges", "external_edges")


def shortest_path(edges: DataFrame, start: int, goal: int, max_depth: int = 20, max_visited: int | None = None) -> DataFrame:
    """(step, edge_id, src, dst, kind) of a path with the fewest hops; no rows without one.

    Neighbours are visited in the order (node, edge, kind), a level by the rank of
    its parents: the first discovery of a node fixes its parent.  Edges without an
    ``id`` go by (src, dst, kind).  More than ``max_visited`` nodes are an error.
    """
    spark = edges.sparkSession
    schema = "step long, edge_id long, src long, dst long, kind string"
    e = edges.select("src", "dst", "kind", (F.col("id") if "id" in edges.columns else F.xxhash64("src", "dst", "kind")).alias("edge_id"))
    seen = cut(spark.createDataFrame([(start, 0, None, None, None, 0)], "node long, rank long, parent long, edge_id long, kind string, depth long"))
    front, depth = seen, 0
    while start != goal and depth < max_depth:
        depth += 1
        ahead = front.select(F.col("node").alias("src"), F.col("rank").alias("parent_rank")).join(e, "src").join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        first = Window.partitionBy("dst").orderBy("parent_rank", "edge_id", "kind")
        new = ahead.withColumn("n", F.row_number().over(first)).where("n = 1")
        # places within a level: by parent, then node
        ranked = ranks.numbered(new, "parent_rank", "dst", name="rank", start=1)
        front = cut(ranked.select(F.col("dst").alias("node"), "rank", F.col("src").alias("parent"), "edge_id", "kind", F.lit(depth).cast("long").alias("depth")))
        seen = seen.union(front)
        if max_visited is not None and seen.count() > max_visited:
            raise ValueError(f"more than {max_visited} nodes visited")
        if front.isEmpty() or not front.where(F.col("node") == goal).isEmpty():
            break
    rows, node = [], goal
    for d in range(depth, 0, -1):
        hit = seen.where((F.col("node") == node) & (F.col("depth") == d)).first()
        if hit is None:
            return spark.createDataFrame([], schema)
        rows.append((d, hit["edge_id"], hit["parent"], node, hit["kind"]))
        node = hit["parent"]
    return spark.createDataFrame(rows[::-1], schema)


def k_hop(nodes: DataFrame, edges: DataFrame, start: int, kind: str, depth: int, incoming: bool = False, limit: int | None = None) -> DataFrame:
    """Nodes within ``depth`` hops over one kind of edge, without the start: (id, qualified_name, depth), sorted, first ``limit``."""
    from .traverse import levels

    found = levels(edges.where(F.col("kind") == kind), nodes.where(F.col("id") == start).select("id"), depth, incoming).where(F.col("id") != start)
    out = nodes.join(found, "id").select("id", "qualified_name", "depth").orderBy("qualified_name", *S.unsigned_order("id"))
    return out.limit(limit) if limit is not None else out


def impact(nodes: DataFrame, edges: DataFrame, target: int, max_depth: int = 3) -> DataFrame:
    """Who depends on a node: (id, qualified_name, file, depth, impact, because, path), in order.

    Reverse search over all kinds but Contains.  The first discovery, by rank of
    the parent and canonical order of edges, fixes depth, path and kind: Direct at
    depth 1 and Transitive beyond over calls and imports, else Possible.
    """
    names = nodes.select("id", "name", "qualified_name", "file")
    e = edges.where("kind <> 'Contains'").select("kind", "src", "dst", S.code(F.col("kind"), S.EDGE_KINDS).alias("code"))
    seen = cut(nodes.where(F.col("id") == target).select("id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("rank"), F.lit(None).cast("string").alias("kind"), "name", F.lit(None).cast("string").alias("because"), F.col("qualified_name").alias("path")))
    front = seen
    for d in range(1, max_depth + 1):
        ahead = front.select(F.col("id").alias("dst"), F.col("rank").alias("parent_rank"), F.col("name").alias("parent"), F.col("path").alias("before")).join(among(e, "dst", front), "dst").join(seen.select(F.col("id").alias("src")), "src", "left_anti")
        first = Window.partitionBy("src").orderBy("parent_rank", "code", "dst")
        new = cut(ahead.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n"))
        new = new.join(among(names, "id", new.select(F.col("src").alias("id"))).withColumnRenamed("id", "src"), "src")
        new = ranks.numbered(new, "parent_rank", "code", "src", name="rank", start=1)
        front = cut(new.select(F.col("src").alias("id"), F.lit(d).cast("long").alias("depth"), "rank", "kind", "name", F.concat("name", F.lit(" -> "), F.lower("kind"), F.lit(" -> "), "parent").alias("because"), F.concat("before", F.lit(" > "), "qualified_name").alias("path")))
        if front.isEmpty():
            break
        seen = seen.union(front)
    hard = F.col("kind").isin("Calls", "Imports")
    kind = F.when(hard & (F.col("depth") == 1), "Direct").when(hard, "Transitive").otherwise("Possible")
    return seen.where("depth > 0").select("id", "depth", "because", "path", kind.alias("impact"), "rank").join(among(names.drop("name"), "id", seen), "id").select("id", "qualified_name", "file", "depth", "impact", "because", "path", "rank")


def impact_counts(hit: DataFrame) -> DataFrame:
    """One row: total, direct, transitive, possible, files, test_files."""
    return hit.agg(
        F.count("*").alias("total"), *(F.count_if(F.col("impact") == k).alias(k.lower()) for k in ("Direct", "Transitive", "Possible")),
        F.count_distinct("file").alias("files"), F.count_distinct(F.when(S.is_test_file(F.col("file")), F.col("file"))).alias("test_files"),
    )


def closure(file_edges: DataFrame, seeds: DataFrame, undirected: bool = False) -> DataFrame:
    """Files (id) that the seeds (id) reach over file-level edges (src, dst), until nothing is new."""
    step = file_edges.select(F.col("src").alias("id"), F.col("dst").alias("next"))
    if undirected:
        step = step.union(file_edges.select("dst", "src"))
    step = cut(step.distinct())
    seen = front = cut(seeds.select("id").distinct())
    while not front.isEmpty():
        front = cut(front.join(step, "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = seen.union(front)
    return seen

"""Snapshots compared, layer rules, history, call-graph refinement, value flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import schema as S
from ..sources.tables import cut, renewed, superseded
from .traverse import among

#: What a node is, whatever its id.
KEY = ("language", "file", "kind", "qualified_name", "container", "signature")
STATE = ("location", "visibility")


def filled(nodes: DataFrame) -> DataFrame:
    """Nodes with every column that comparisons look at, null where there is none."""
    for c in (*KEY, *STATE):
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, F.lit(None).cast("string"))
    return nodes


def same(a: DataFrame, b: DataFrame, keys) -> list[Column]:
    return [a[k].eqNullSafe(b[k]) for k in keys]


def node_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, qualified_name, kind, file): nodes added, removed, or modified in place or visibility, by their semantic key."""
    old, new = filled(old), filled(new)
    show = ["qualified_name", "kind", "file"]
    added = new.join(old, same(new, old, KEY), "left_anti").select(F.lit("added").alias("change"), *show)
    removed = old.join(new, same(old, new, KEY), "left_anti").select(F.lit("removed").alias("change"), *show)
    moved = [~new[c].eqNullSafe(old[c]) for c in STATE]
    modified = new.join(old, same(new, old, KEY)).where(moved[0] | moved[1]).select(F.lit("modified").alias("change"), *(new[c] for c in show))
    return added.union(removed).union(modified)


def semantic_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with a hash of the key of either end, as 32 bytes; those without both ends vanish."""
    key = filled(nodes).select("id", F.unhex(F.sha2(F.to_json(F.struct(*KEY)), 256)).alias("key"))
    e = edges if "label" in edges.columns else edges.withColumn("label", F.lit(None).cast("string"))
    return e.join(key.select(F.col("id").alias("src"), F.col("key").alias("src_key")), "src").join(key.select(F.col("id").alias("dst"), F.col("key").alias("dst_key")), "dst")


def edge_diff(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> DataFrame:
    """(change, kind, src, dst, label): edges, multi-edges kept, whose ends, kind and label the other snapshot lacks."""
    old, new = semantic_edges(old_nodes, old_edges), semantic_edges(new_nodes, new_edges)
    keys = ("src_key", "dst_key", "kind", "label")
    show = ["kind", "src", "dst", "label"]
    added = new.join(old, same(new, old, keys), "left_anti").select(F.lit("added").alias("change"), *show)
    return added.union(old.join(new, same(old, new, keys), "left_anti").select(F.lit("removed").alias("change"), *show))


def classes(nodes: DataFrame) -> DataFrame:
    """(id, of): nodes with a number that those of the same semantic key share, told by half its SHA-256.

    Numbers are given after nodes of a key have met, as ids may repeat; they differ from run to run.
    """
    key = F.substring(F.unhex(F.sha2(F.to_json(F.struct(*KEY)), 256)), 1, 16)
    n = filled(nodes).select("id", key.alias("key")).repartition("key").withColumn("row", F.monotonically_increasing_id())
    return n.select("id", F.min("row").over(Window.partitionBy("key")).alias("of"))


def marked_diff(nodes: DataFrame, edges: DataFrame, old: Column, new: Column) -> DataFrame:
    """:func:`edge_diff` of two snapshots with the same nodes, each told by a condition on edges.

    Only edges of one snapshot can be a change.  What both hold is looked at as far
    as it may equal one: of a kind that some such edge has, with ends of the keys
    of its ends.  Ends go by classes of nodes, numbers instead of hashes.
    """
    e = edges if "label" in edges.columns else edges.withColumn("label", F.lit(None).cast("string"))
    e = e.withColumn("was", F.coalesce(old, F.lit(False))).withColumn("now", F.coalesce(new, F.lit(False))).withColumn("any_kind", F.coalesce("kind", F.lit("")))
    of = renewed(classes(nodes))
    end = lambda ids, name, key: ids.select(F.col("id").alias(name), F.col("of").alias(key)).hint("shuffle_hash")
    only = e.where("was <> now").select("kind", "any_kind", "label", "src", "dst", "now")
    only = renewed(only.join(end(of, "src", "a"), "src").join(end(of, "dst", "b"), "dst"))
    met = lambda key: of.join(only.select(F.col(key).alias("of")).distinct().hint("shuffle_hash"), "of", "left_semi")
    both = among(e.where("was AND now"), "any_kind", only.select(F.col("any_kind").alias("id"))).select("kind", "label", "src", "dst")
    both = both.join(end(met("a"), "src", "a"), "src").join(end(met("b"), "dst", "b"), "dst")
    both = renewed(both.select("kind", "label", "a", "b").distinct())
    superseded(of)
    rows = only.select("kind", "label", "src", "dst", "a", "b", F.when(F.col("now"), 2).otherwise(1).alias("held"))
    rows = rows.union(both.select("kind", "label", F.lit(None).cast("long"), F.lit(None).cast("long"), "a", "b", F.lit(3)))
    seen = F.bit_or("held").over(Window.partitionBy("a", "b", "kind", "label"))
    change = F.when(F.col("held") == 2, "added").otherwise("removed")
    return rows.withColumn("seen", seen).where("held < 3 AND seen = held").select(change.alias("change"), "kind", "src", "dst", "label")


def api_slots(nodes: DataFrame) -> DataFrame:
    """Public nodes with the running number within file, name and kind."""
    n = filled(nodes)
    n = n.where(S.is_public(F.col("kind"), F.col("name"), F.col("file"), F.col("visibility")))
    w = Window.partitionBy("file", "name", "kind").orderBy("signature", "qualified_name", "location", "id")
    return n.withColumn("slot", F.row_number().over(w) - 1)


def api_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, symbol, old_signature, new_signature, breaking) of the public interface.

    Matched by file, name, kind, signature and number, else by the same without
    the signature, which makes a breaking modification.
    """
    cols = ["qualified_name", "file", "name", "kind", "signature", "slot", "visibility"]
    o, n = cut(api_slots(old).select(*cols)), cut(api_slots(new).select(*cols))
    before = o.select(*(F.col(c).alias(f"o_{c}") for c in cols))
    after = n.select(*(F.col(c).alias(f"n_{c}") for c in cols))
    loose = [F.col(f"n_{c}").eqNullSafe(F.col(f"o_{c}")) for c in ("file", "name", "kind", "slot")]
    exact = [*loose, F.col("n_signature").eqNullSafe(F.col("o_signature"))]
    show = lambda change, symbol, was, now, breaking: [F.lit(change).alias("change"), F.col(symbol).alias("symbol"), was.cast("string").alias("old_signature"), now.cast("string").alias("new_signature"), breaking.alias("breaking")]
    none, was, now = F.lit(None), F.col("o_signature"), F.col("n_signature")
    both = after.join(before, exact).where(~F.col("n_visibility").eqNullSafe(F.col("o_visibility")))
    changed = both.select(*show("modified", "n_qualified_name", was, now, (F.col("o_visibility") == "public") & ~F.col("n_visibility").eqNullSafe(F.lit("public"))))
    only_new, only_old = after.join(before, exact, "left_anti"), before.join(after, exact, "left_anti")
    pairs = only_new.join(before, loose).select(*show("modified", "n_qualified_name", was, now, F.lit(True)))
    added = only_new.join(before, loose, "left_anti").select(*show("added", "n_qualified_name", none, now, F.lit(False)))
    removed = only_old.join(after, loose, "left_anti").select(*show("removed", "o_qualified_name", was, none, F.lit(True)))
    return changed.union(pairs).union(added).union(removed)


def layer_of(file: Column, layers: list[tuple[str, list[str], list[str]]]) -> Column:
    """Layer with the most specific matching pattern, then the smallest name; null without one.

    ``layers`` are (name, path patterns, allowed layers): rules, not data.
    """
    path = F.regexp_replace(F.replace(file, F.lit("\\"), F.lit("/")), "^/+", "")
    options = [F.when(path.rlike(rule[0]), F.struct(F.lit(-rule[1]).alias("w"), F.lit(name).alias("name"))) for name, patterns, _ in layers for rule in map(S.layer_regex, patterns) if rule]
    if not options:
        return F.lit(None).cast("string")
    return F.array_min(F.filter(F.array(*options), lambda x: x.isNotNull()))["name"]


def layer_edges(nodes: DataFrame, edges: DataFrame, layers) -> DataFrame:
    """(kind, from_file, to_file, from_layer, to_layer, allowed) of edges between nodes with a layer, Contains left out."""
    of = nodes.select("id", "file", layer_of(F.col("file"), layers).alias("layer")).where("layer IS NOT NULL")
    rules = F.create_map(*(x for name, _, allowed in layers for x in (F.lit(name), F.array(*map(F.lit, allowed)).cast("array<string>"))))
    e = edges.where("kind <> 'Contains'").join(of.select(F.col("id").alias("src"), F.col("file").alias("from_file"), F.col("layer").alias("from_layer")), "src")
    e = e.join(of.select(F.col("id").alias("dst"), F.col("file").alias("to_file"), F.col("layer").alias("to_layer")), "dst")
    return e.withColumn("allowed", (F.col("from_layer") == F.col("to_layer")) | F.array_contains(rules[F.col("from_layer")], F.col("to_layer")))


def violations(nodes: DataFrame, edges: DataFrame, layers) -> DataFrame:
    """Distinct breaches of the layer rules."""
    return layer_edges(nodes, edges, layers).where("NOT allowed").select("from_file", "to_file", "from_layer", "to_layer", "kind").distinct()


def layer_report(nodes: DataFrame, edges: DataFrame, layers) -> DataFrame:
    """One row: total_edges_evaluated, violations_count, passed."""
    e = layer_edges(nodes, edges, layers)
    n = e.agg(F.count("*").alias("total_edges_evaluated"))
    return n.join(violations(nodes, edges, layers).agg(F.count("*").alias("violations_count"))).withColumn("passed", F.col("violations_count") == 0)


def file_churn(records: DataFrame) -> DataFrame:
    """Of (commit, author, file, additions, deletions, binary) rows: commits (rows), additions, deletions, authors, binary changes of every file."""
    return records.groupBy("file").agg(F.count("*").alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.array_join(F.array_sort(F.collect_set("author")), ",").alias("authors"), F.count_if("binary").alias("binary_changes"))


def often(n: DataFrame, total: DataFrame, min_support: float) -> DataFrame:
    """Files (file, n) in enough of all commits (total, one row) to be part of a pair."""
    return n.join(F.broadcast(total)).where(F.col("n") >= min_support * F.col("total")).drop("total")  # one row is broadcast


def co_change(commits: DataFrame, min_support: float, block: int = 64) -> DataFrame:
    """Pairs of files a < b that change together, with support and both confidences.

    Files of a commit are numbered into blocks; a commit is joined block by block,
    so a commit of very many files is spread over tasks, and none of its pairs is
    left out.  A pair changes together at most as often as either file changes, so
    files in too few commits are left out before the pairs are made.
    """
    c = commits.select("commit", "file").distinct()
    total = c.agg(F.count_distinct("commit").alias("total"))
    n = c.groupBy("file").agg(F.count("*").alias("n"))
    c = c.join(often(n, total, min_support).select("file"), "file", "left_semi")
    sized = c.join(c.groupBy("commit").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "commit")
    mine = F.pmod(F.xxhash64("file"), F.col("blocks")).cast("int")
    left = sized.select("commit", F.col("file").alias("file_a"), mine.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    right = sized.select("commit", F.col("file").alias("file_b"), mine.alias("j"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    pairs = left.join(right, ["commit", "i", "j"]).where("file_a < file_b").groupBy("file_a", "file_b").agg(F.count("*").alias("co_commits"))
    pairs = pairs.join(F.broadcast(total)).where(F.col("co_commits") >= min_support * F.col("total"))  # one row is broadcast
    out = pairs.join(n.select(F.col("file").alias("file_a"), F.col("n").alias("commits_a")), "file_a").join(n.select(F.col("file").alias("file_b"), F.col("n").alias("commits_b")), "file_b")
    ratio = lambda a, b: F.round(F.col(a) / F.col(b), 6)
    return out.select("file_a", "file_b", "co_commits", "commits_a", "commits_b", ratio("co_commits", "total").alias("support"), ratio("co_commits", "commits_a").alias("conf_a_b"), ratio("co_commits", "commits_b").alias("conf_b_a"))


def refined_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(caller, callee, candidate, confidence): dispatch targets of calls to methods of traits and interfaces.

    A call to a method that a trait or interface contains may reach the methods of
    equal name that its implementors contain (Inferred).  Calls of a caller without
    any such candidate fall back on all methods of the callee's name, if that is
    longer than two letters (Possible).
    """
    n = nodes.select("id", "kind", "name")
    calls = edges.where("kind = 'Calls'").select(F.col("src").alias("caller"), F.col("dst").alias("callee")).distinct().join(n.select(F.col("id").alias("callee"), "name"), "callee")
    holds = edges.where("kind = 'Contains'").select(F.col("src").alias("owner"), F.col("dst").alias("member"))
    traits = holds.join(n.where("kind IN ('Trait', 'Interface')").select(F.col("id").alias("owner")), "owner").select(F.col("owner").alias("trait"), F.col("member").alias("callee"))
    links = edges.where("kind IN ('Implements', 'Inherits')").select(F.col("src").alias("owner"), F.col("dst").alias("trait")).distinct()
    methods = holds.join(n.select(F.col("id").alias("member"), F.col("name")), "member").select("owner", "name", F.col("member").alias("candidate"))
    inferred = calls.join(traits, "callee").join(links, "trait").join(methods, ["owner", "name"]).where("candidate <> callee").select("caller", "callee", "candidate").distinct().withColumn("confidence", F.lit("Inferred"))
    rest = calls.join(inferred.select("caller").distinct(), "caller", "left_anti").where(F.length("name") > 2)
    possible = rest.join(n.where("kind = 'Method'").select("name", F.col("id").alias("candidate")), "name").where("candidate <> callee").select("caller", "callee", "candidate").distinct().withColumn("confidence", F.lit("Possible"))
    return inferred.union(possible)


def flow_paths(flow: DataFrame, sources: DataFrame, sinks: DataFrame, max_depth: int = 15, max_paths: int | None = None) -> DataFrame:
    """Simple paths from sources to sinks (id) over flow edges (src, dst, confidence): (path, length, confidence), shortest first.

    The confidence of a path is that of its weakest step.  Walks of exact length
    back from the sinks come first; a path goes on only to nodes from which a
    sink is so many steps away as are left.  With ``max_paths`` the search ends
    with the level that fills it, and where the nodes on such walks form no
    cycle, so that every kept path does end, a level keeps of each final length
    only as many paths as are still wanted, in their order.
    """
    weak = lambda c: S.code(c, S.CONFIDENCES)
    e = flow.groupBy("src", "dst").agg(F.min(weak(F.col("confidence"))).alias("code")).where("src <> dst")
    goal = cut(sinks.select(F.col("id").alias("node")).distinct())
    # (node, left): a sink is exactly so many steps ahead, walks through other sinks included
    e, front = cut(e), goal.withColumn("left", F.lit(0))
    ahead = front
    for n in range(1, max_depth + 1):
        front = cut(front.select(F.col("node").alias("dst")).join(e, "dst").select(F.col("src").alias("node")).distinct().withColumn("left", F.lit(n)))
        if front.isEmpty():
            break
        ahead = cut(ahead.union(front))
    on_way = ahead.select("node").distinct()
    e = cut(e.join(on_way.withColumnRenamed("node", "src"), "src", "left_semi").join(on_way.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    bounded = max_paths is not None and acyclic(e)
    lefts = ahead.groupBy(F.col("node").alias("at")).agg(F.array_sort(F.collect_set("left")).alias("lefts"))
    paths = cut(sources.select(F.array(F.col("id").cast("string")).alias("path"), F.col("id").alias("at"), F.lit(1).alias("code")).distinct())
    found = paths.select(F.array_join("path", " -> ").alias("path"), F.lit(0).cast("long").alias("length"), F.lit("").alias("confidence")).limit(0)
    held = 0
    for n in range(1, max_depth + 1):
        step = paths.withColumnRenamed("at", "src").withColumnRenamed("code", "before").join(e, "src").where(~F.array_contains("path", F.col("dst").cast("string")))
        step = step.select(F.concat("path", F.array(F.col("dst").cast("string"))).alias("path"), F.col("dst").alias("at"), F.greatest("before", "code").alias("code"))
        step = cut(step.join(lefts, "at").where(F.exists("lefts", lambda x: x <= max_depth - n)))
        hit = step.where(F.array_contains("lefts", 0)).select(F.array_join("path", " -> ").alias("path"), F.lit(n).cast("long").alias("length"), F.element_at(F.array(*map(F.lit, S.CONFIDENCES)), F.col("code")).alias("confidence"))
        found = cut(found.union(hit))
        held = found.count() if max_paths is not None else 0
        if step.isEmpty() or (max_paths is not None and held >= max_paths):
            break
        paths = step.drop("lefts")
        if bounded:
            each = step.select("path", "at", "code", F.array_join("path", " -> ").alias("text"), F.explode(F.filter("lefts", lambda x: (x > 0) & (x <= max_depth - n))).alias("left"))
            first = Window.partitionBy("left").orderBy("text")
            paths = cut(each.withColumn("r", F.row_number().over(first)).where(F.col("r") <= max_paths - held).select("path", "at", "code").distinct())
    return found.orderBy("length", "path").limit(max_paths) if max_paths is not None else found


def acyclic(e: DataFrame) -> bool:
    """Whether edges (src, dst) form no cycle: nodes without an edge in, or none out, are peeled off until none is left."""
    left = e.select("src", "dst")
    while True:
        size = left.count()
        if not size:
            return True
        inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        left = cut(inner.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if left.count() == size:
            return False


def named_flows(flow: DataFrame, names: DataFrame, source: str, sink: str, **limits) -> DataFrame:
    """:func:`flow_paths` from nodes whose name (id, name) contains ``source`` to those whose name contains ``sink``."""
    with_name = lambda text: names.where(F.lower("name").contains(text.lower())).select("id")
    return flow_paths(flow, with_name(source), with_name(sink), **limits)


def call_flow(calls: DataFrame, arguments: DataFrame, parameters: DataFrame, returns: DataFrame) -> DataFrame:
    """Flow edges (src, dst, kind, confidence) between functions.

    calls (call, caller, callee, assigned), arguments (call, position, variable),
    parameters (function, position, variable), returns (function, variable): an
    argument flows into the parameter of its position, a returned variable into
    what the call is assigned to.
    """
    passed = calls.join(arguments, "call").join(parameters.select(F.col("function").alias("callee"), "position", F.col("variable").alias("into")), ["callee", "position"])
    got = calls.where("assigned IS NOT NULL").join(returns.select(F.col("function").alias("callee"), F.col("variable").alias("out")), "callee")
    return passed.select(F.col("variable").alias("src"), F.col("into").alias("dst"), F.lit("argument").alias("kind"), F.lit("Resolved").alias("confidence")).union(got.select("out", "assigned", F.lit("return"), F.lit("Inferred"))).distinct()


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): Added, Modified, Deleted or Unchanged by size, hash, language and parser version, never by time."""
    keys = [c for c in ("size", "hash", "language", "parser_version") if c in old.columns and c in new.columns]
    o, n = old.select("path", F.struct(*keys).alias("old")), new.select("path", F.struct(*keys).alias("new"))
    change = F.when(F.col("old").isNull(), "Added").when(F.col("new").isNull(), "Deleted").when(F.col("old").eqNullSafe(F.col("new")), "Unchanged").otherwise("Modified")
    return o.join(n, "path", "full_outer").select("path", change.alias("change"))

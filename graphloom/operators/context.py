"""Token-budgeted context around symbols: seeds, expansion, ranking, slices, budget, bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions.text import approx_tokens, byte_cut, inside_root
from ..sources.tables import cut
from . import intel, ranks


def seeds(nodes: DataFrame, symbol: str | None = None, file: str | None = None, query: str | None = None, changed: DataFrame | None = None, ranks: DataFrame | None = None) -> DataFrame:
    """Start nodes (id): matches of a symbol, of a file (equal or as a suffix), the ten best of a search, changed files (path)."""
    from .queries import find

    parts = [nodes.limit(0).select("id")]
    if symbol:
        parts.append(find(nodes, symbol).select("id"))
    if file:
        parts.append(nodes.where((F.col("file") == file) | F.col("file").endswith("/" + file)).select("id"))
    if query:
        parts.append(intel.ranked_search(nodes, query, ranks, limit=10).select("id"))
    if changed is not None:
        parts.append(nodes.join(changed.select(F.col("path").alias("file")), "file", "left_semi").select("id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def expanded(nodes: DataFrame, edges: DataFrame, start: DataFrame, max_depth: int = 3, max_candidates: int | None = 100) -> DataFrame:
    """(id, role, distance, rank): search from the seeds in the phases container, callees, callers, implementations, types.

    The first discovery, by rank of the parent, phase, then edge order, fixes role and distance.
    """
    of = nodes.select("id", "kind", "name", "file")
    found = intel.discovered_tests(nodes, edges)
    at = start.join(nodes.select("id", "file", "qualified_name", "name"), "id")
    by_file = at.join(found, at["file"] == found["source_file"]).select("test_file", "test_symbol")
    by_symbol = at.join(found, (found["source_symbol"] == at["qualified_name"])).select("test_file", "test_symbol")
    tests = by_file.union(by_symbol).distinct()
    test_ids = tests.where("test_symbol IS NOT NULL").join(nodes.select("id", F.col("qualified_name").alias("test_symbol")), "test_symbol").select("id").union(tests.where("test_symbol IS NULL").join(nodes.where("kind = 'File'").select("id", F.col("file").alias("test_file")), "test_file").select("id")).distinct()
    first = start.select("id").distinct().withColumn("role", F.lit("Seed")).withColumn("distance", F.lit(0).cast("long"))
    first = cut(ranks.numbered(first, *S.unsigned_order("id"), name="rank", start=1))
    tested = test_ids.join(first, "id", "left_anti").select("id", F.lit("Test").alias("role"), F.lit(1).cast("long").alias("distance"), F.lit(0).cast("long").alias("rank"))
    seen = cut(first.union(tested))
    front = first
    e = edges.select("kind", "src", "dst", S.code(F.col("kind"), S.EDGE_KINDS).alias("code"))
    steps = [
        (0, e.where("kind = 'Contains'").select(F.col("dst").alias("a"), F.col("src").alias("b"), "code"), "Container"),
        (1, e.where("kind = 'Calls'").select(F.col("src").alias("a"), F.col("dst").alias("b"), "code"), "Callee"),
        (2, e.where("kind = 'Calls'").select(F.col("dst").alias("a"), F.col("src").alias("b"), "code"), "Caller"),
        (3, e.where("kind IN ('Implements', 'Inherits')").select(F.col("src").alias("a"), F.col("dst").alias("b"), "code").union(e.where("kind IN ('Implements', 'Inherits')").select("dst", "src", "code")), "Implementation"),
        (4, e.where("kind IN ('Imports', 'Calls')").join(nodes.where(F.col("kind").isin(*intel.TYPES)).select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b"), "code"), "ReferencedType"),
    ]
    links = None
    for phase, step, role in steps:
        step = step.select("a", "b", "code", F.lit(phase).alias("phase"), F.lit(role).alias("role"))
        links = step if links is None else links.union(step)
    for d in range(1, min(max_depth, 5) + 1):
        ahead = front.select(F.col("id").alias("a"), F.col("rank").alias("parent_rank")).join(links, "a").join(seen.select(F.col("id").alias("b")), "b", "left_anti")
        new = ahead.withColumn("n", F.row_number().over(Window.partitionBy("b").orderBy("parent_rank", "phase", "code", "a"))).where("n = 1")
        new = new.join(of.select(F.col("id").alias("b"), "name", "file"), "b")
        role = F.when((F.col("role") == "Caller") & S.looks_like_test(F.col("name"), F.col("file")), "Test").when(F.col("role").isin("Caller", "Callee") & F.lit(d > 1), "IndirectNeighbor").otherwise(F.col("role"))
        new = ranks.numbered(new, "parent_rank", "phase", "code", "b", name="rank", start=1)
        front = cut(new.select(F.col("b").alias("id"), role.alias("role"), F.lit(d).cast("long").alias("distance"), "rank"))
        if front.isEmpty():
            break
        seen = seen.union(front)
        if max_candidates is not None and seen.count() >= max_candidates:
            break
    return seen.orderBy("distance", "rank", "id").limit(max_candidates) if max_candidates is not None else seen


def role_score(role: Column, distance: Column) -> Column:
    """What a role is worth."""
    return (
        F.when(role == "Seed", 1000.0)
        .when(role.isin("Caller", "Callee"), F.when(distance <= 1, 800.0).when(distance == 2, 500.0).otherwise(250.0))
        .when(role == "Container", 750.0)
        .when(role == "ReferencedType", 700.0)
        .when(role == "Implementation", 650.0)
        .when(role == "IndirectNeighbor", F.when(distance == 2, 500.0).when(distance == 3, 250.0).otherwise(100.0))
        .otherwise(200.0)
    )


def ranked(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates with score, in the order score, distance, qualified name, id."""
    j = candidates.join(nodes.select("id", "qualified_name"), "id").withColumn("score", role_score(F.col("role"), F.col("distance")))
    return j.select("id", "qualified_name", "role", "distance", "score").orderBy(F.desc("score"), "distance", "qualified_name", *S.unsigned_order("id"))


def spans_of(nodes: DataFrame) -> DataFrame:
    """(id, file, start_line, start_col, end_line, end_col) of nodes with a ``location``."""
    return nodes.select("id", *(F.col(f"location.{c}").alias(c) for c in ("file", "start_line", "start_col", "end_line", "end_col")))


def slices(spans: DataFrame, files: DataFrame) -> DataFrame:
    """Text of spans (id, file, start_line, start_col, end_line, end_col) in files (path, content), with its cost.

    Columns are 1-based bytes.  An end column of 1 or less takes its whole line; a
    cut inside a letter moves forward at the start and back at the end.  A line
    ends at a line feed, with a carriage return before it; lines below 1 and files
    that are not there give an empty text, a path that leaves the root is an error.
    """
    j = spans.withColumn("key_", inside_root(F.col("file"))).join(files.select(F.col("path").alias("key_"), "content"), "key_", "left")
    # a text is split only as far as its span goes, and each step is worked out once
    j = j.withColumn("lines_", F.split(F.coalesce("content", F.lit("")), "\r?\n", F.least(F.greatest(F.col("end_line"), F.lit(0)), F.lit(2**31 - 2)).cast("int") + 1)).drop("content", "key_")
    lines = F.col("lines_")
    count = F.when(F.col("start_line") < 1, F.lit(0)).otherwise(F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)))
    j, part = j.withColumn("part_", F.slice(lines, F.greatest(F.col("start_line"), F.lit(1)), count)).drop("lines_"), F.col("part_")
    n, first, last = F.size(part), F.element_at(part, 1), F.element_at(part, -1)
    start = F.greatest(F.col("start_col") - 1, F.lit(0))
    end = F.when(F.col("end_col") <= 1, F.octet_length(last)).otherwise(F.col("end_col") - 1)
    many = F.concat(F.array(byte_cut(first, start, F.octet_length(first))), F.slice(part, 2, F.greatest(n - 2, F.lit(0))), F.array(byte_cut(last, F.lit(0), end)))
    text = F.when(n == 0, "").when(n == 1, byte_cut(first, start, end)).otherwise(F.array_join(many, "\n"))
    j, text = j.withColumn("text_", F.coalesce(text, F.lit(""))), F.col("text_")
    return j.select("id", "file", "start_line", "end_line", text.alias("text"), approx_tokens(text).alias("tokens"), F.octet_length(text).cast("long").alias("bytes"), F.length(text).cast("long").alias("characters"))


def allocated(items: DataFrame, limit: int, group: str | None = None) -> DataFrame:
    """Skip-greedy budget over (rank, id, cost): an item is kept if it fits, or is the first; later smaller ones may still fit.

    Items of a group meet in one fold: a group is one request's candidates, at most
    a few hundred of them.
    """
    keys = [group] if group else []
    listed = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "cost"))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def step(a, x):
        fits = (a["used"] + x["cost"] <= limit) | (F.size(a["kept"]) == 0)
        return F.struct(F.when(fits, a["used"] + x["cost"]).otherwise(a["used"]).alias("used"), F.when(fits, F.concat(a["kept"], F.array(x["id"]))).otherwise(a["kept"]).alias("kept"))

    folded = listed.withColumn("f", F.aggregate("items", start, step))
    out = folded.select(*keys, F.explode("items").alias("i"), F.col("f.kept").alias("kept"))
    return out.select(*keys, "i.rank", "i.id", "i.cost", F.array_contains("kept", F.col("i.id")).alias("included"))


def bundled(items: DataFrame) -> DataFrame:
    """Of slices (file, start_line, end_line, id, tokens) those that no other of the file encloses, with totals of their file."""
    w = Window.partitionBy("file").orderBy("start_line", F.desc("end_line"), "id").rowsBetween(Window.unboundedPreceding, -1)
    kept = items.withColumn("before", F.max("end_line").over(w)).where("before IS NULL OR before < end_line").drop("before")
    totals = Window.partitionBy("file")
    return kept.withColumn("file_slices", F.count("*").over(totals)).withColumn("file_tokens", F.sum("tokens").over(totals))


def context(nodes: DataFrame, edges: DataFrame, files: DataFrame, start: DataFrame, limit: int = 8000, max_depth: int = 3, max_candidates: int = 100) -> DataFrame:
    """The bundle: slices (file, start_line, end_line, id, tokens, text, totals) of what fits the budget, nodes with a ``location``."""
    found = ranked(expanded(nodes, edges, start, max_depth, max_candidates), nodes)
    order = ranks.numbered(found, F.desc("score"), "distance", "qualified_name", *S.unsigned_order("id"), name="rank", start=1)
    cut_out = slices(spans_of(nodes.join(order.select("id"), "id", "left_semi")), files)
    fit = allocated(order.join(cut_out.select("id", F.col("tokens").alias("cost")), "id").select("rank", "id", "cost"), limit).where("included")
    return bundled(cut_out.join(fit.select("id"), "id", "left_semi"))

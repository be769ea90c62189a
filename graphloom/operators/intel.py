"""Search, explanation, neighbourhoods, tests, entry points, overview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions.text import relevance
from . import graphs

TYPES = ("Struct", "Trait", "Interface", "Class")


def ranked_search(nodes: DataFrame, term: str, ranks: DataFrame | None = None, kind: str | None = None, file: str | None = None, limit: int | None = None) -> DataFrame:
    """(id, qualified_name, score): lexical score plus ten times the PageRank of the symbol of that qualified name.

    A blank term finds nothing; a hit in the path alone is a hit; ``ranks`` is (id, rank) over the symbol projection.
    """
    if not term.strip():
        return nodes.limit(0).select("id", "qualified_name", F.lit(0.0).alias("score"))
    some = nodes if kind is None else nodes.where(F.col("kind") == kind)
    some = some if file is None else some.where(F.col("file").contains(file))
    hit = some.withColumn("lexical", relevance(F.col("name"), F.col("qualified_name"), F.col("file"), term)).where("lexical > 0")
    if ranks is None:
        scored = hit.withColumn("score", F.col("lexical").cast("double"))
    else:
        scored = hit.join(ranks.select(F.col("id").alias("qualified_name"), "rank"), "qualified_name", "left").withColumn("score", F.col("lexical") + 10 * F.when(F.col("kind") == "File", 0.0).otherwise(F.coalesce("rank", F.lit(0.0))))
    out = scored.select("id", "qualified_name", "score").orderBy(F.desc("score"), "qualified_name", *S.unsigned_order("id"))
    return out.limit(limit) if limit is not None else out


def related(edges: DataFrame, node: int, incoming: bool = False) -> DataFrame:
    """Distinct neighbours (id) of a node."""
    a, b = ("dst", "src") if incoming else ("src", "dst")
    return edges.where(F.col(a) == node).select(F.col(b).alias("id")).distinct()


def explained(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For every node: parent (least source of Contains, as an unsigned number), distinct neighbours each way, callers, callees, imports (by edge).

    With its highest bit turned a long has the order of an unsigned number; its
    least is kept in a hash table, where that of a struct would sort all edges.
    """
    turned = lambda c: c.bitwiseXOR(F.lit(-(1 << 63)))
    inn = edges.groupBy(F.col("dst").alias("id")).agg(turned(F.min(F.when(F.col("kind") == "Contains", turned(F.col("src"))))).alias("parent"), F.count_distinct("src").alias("incoming"), F.count_if(F.col("kind") == "Calls").alias("callers"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("outgoing"), F.count_if(F.col("kind") == "Calls").alias("callees"), F.count_if(F.col("kind") == "Imports").alias("imports"))
    return nodes.select("id", "kind", "qualified_name").join(inn, "id", "left").join(out, "id", "left").na.fill(0, ["incoming", "callers", "outgoing", "callees", "imports"])


def references(nodes: DataFrame, edges: DataFrame, node: int) -> DataFrame:
    """(category, id, qualified_name): callers, referenced types, inbound imports, implementations of a node."""
    inn, out = edges.where(F.col("dst") == node), edges.where(F.col("src") == node)
    parts = [
        inn.where("kind = 'Calls'").select(F.lit("caller").alias("category"), F.col("src").alias("id")),
        out.where("kind IN ('Calls', 'Imports')").select(F.lit("type"), "dst"),
        inn.where("kind = 'Imports'").select(F.lit("import"), "src"),
        inn.where("kind IN ('Implements', 'Inherits')").select(F.lit("implementation"), "src"),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    j = every.distinct().join(nodes.select("id", "kind", "qualified_name"), "id")
    return j.where((F.col("category") != "type") | F.col("kind").isin(*TYPES)).select("category", "id", "qualified_name")


def neighbourhood(nodes: DataFrame, edges: DataFrame, node: int, depth: int = 1, limit: int | None = None) -> DataFrame:
    """(role, id, qualified_name, depth) around a node.

    The container is the last of the nodes that contain it, by their unsigned ids,
    the parent the last of those that are modules or files.
    """
    of = nodes.select("id", "kind", "name", "qualified_name", "file")
    one = lambda role, ids: ids.withColumn("role", F.lit(role)).withColumn("depth", F.lit(1).cast("long"))
    contains = edges.where("kind = 'Contains'")
    holders = contains.where(F.col("dst") == node).select(F.col("src").alias("id")).distinct().join(of.select("id", "kind"), "id")
    last = lambda df: df.agg(F.max(F.struct((F.col("id") < 0).alias("high"), "id"))["id"].alias("id")).where("id IS NOT NULL")
    parts = [one("container", last(holders)), one("parent", last(holders.where("kind IN ('Module', 'File')"))), one("child", contains.where(F.col("src") == node).select(F.col("dst").alias("id")).distinct())]
    for role, kind, incoming in (("caller", "Calls", True), ("callee", "Calls", False), ("import", "Imports", False), ("export", "Exports", False)):
        parts.append(graphs.k_hop(nodes, edges, node, kind, depth, incoming, limit).select("id", "depth").withColumn("role", F.lit(role)))
    links = edges.where("kind IN ('Implements', 'Inherits')").where((F.col("src") == node) | (F.col("dst") == node))
    parts.append(one("implementation", links.select(F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("id")).distinct()))
    every = parts[0].select("role", "id", "depth")
    for p in parts[1:]:
        every = every.union(p.select("role", "id", "depth"))
    j = every.join(of, "id")
    types = j.where(F.col("role").isin("callee", "import") & F.col("kind").isin(*TYPES)).withColumn("role", F.lit("type")).dropDuplicates(["id"])
    tests = j.where((F.col("role") == "caller") & S.looks_like_test(F.col("name"), F.col("file"))).withColumn("role", F.lit("test"))
    return j.unionByName(types).unionByName(tests).select("role", "id", "qualified_name", "depth")


def discovered_tests(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_file, source_symbol, test_file, test_symbol, reason), each test once per source.

    Tests that call or import a symbol, and test files whose stem contains, or is
    contained in, that of a source file.  The shorter stem goes by the rarest of
    its runs of three letters (by all it has, if they are fewer), the longer one by
    every run of one to three; what meets there is compared.
    """
    of = nodes.select("id", "name", "qualified_name", "file")
    some = edges.where("kind IN ('Calls', 'Imports')")
    ends = some.join(of.select(F.col("id").alias("src"), F.col("name").alias("test_name"), F.col("qualified_name").alias("test_symbol"), F.col("file").alias("test_file")), "src").where(S.is_test_symbol(F.col("test_name"), F.col("test_file")))
    ends = ends.join(of.select(F.col("id").alias("dst"), "name", F.col("qualified_name").alias("source_symbol"), F.col("file").alias("source_file")), "dst")
    calls = ends.select("source_file", "source_symbol", "test_file", "test_symbol", F.concat(F.lit("test "), "test_name", F.lit(" "), F.lower("kind"), F.lit(" target "), "name").alias("reason"))
    files = nodes.where("kind = 'File'").select("file", S.stem(F.col("file")).alias("stem"), S.is_test_file(F.col("file")).alias("test"))
    n = F.length("stem")
    cut_at = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda a: F.col("stem").substr(a, F.lit(k)))
    runs = F.array_distinct(F.flatten(F.array(*map(cut_at, (1, 2, 3)))))
    holds = files.select("file", "test", F.col("stem").alias("longer"), F.explode(F.array_union(runs, F.array(F.lit("")))).alias("key"))
    full = (F.length("key") == 3) | (F.length("longer") < 3) & (F.col("key") == F.col("longer"))
    own = holds.where(full).join(holds.groupBy("key").agg(F.count("*").alias("often")), "key")
    within = own.groupBy(F.col("file").alias("other"), F.col("test").alias("other_test"), F.col("longer").alias("shorter")).agg(F.min_by("key", F.struct("often", "key")).alias("key"))
    met = holds.join(within, "key").where((F.col("test") != F.col("other_test")) & F.col("longer").contains(F.col("shorter")))
    pairs = met.select(F.when(F.col("test"), F.col("other")).otherwise(F.col("file")).alias("source_file"), F.when(F.col("test"), F.col("file")).otherwise(F.col("other")).alias("test_file")).distinct()
    names = pairs.select("source_file", F.lit(None).cast("string").alias("source_symbol"), "test_file", F.lit(None).cast("string").alias("test_symbol"), F.concat(F.lit("matching naming convention between "), "source_file", F.lit(" and "), "test_file").alias("reason"))
    return calls.union(names).groupBy("source_file", "source_symbol", "test_file", "test_symbol").agg(F.min("reason").alias("reason"))


def tests_of(found: DataFrame, target: str) -> DataFrame:
    """Tests (test_file, test_symbol) of a file or symbol, each once."""
    t = F.lit(target)
    hit = (F.col("source_file") == t) | (F.col("source_symbol") == t) | F.col("source_symbol").endswith(f"::{target}") | F.col("source_file").contains(target)
    return found.where(hit).select("test_file", "test_symbol").distinct()


def entrypoints(nodes: DataFrame) -> DataFrame:
    """(id, qualified_name, entry): main functions by language, and command handlers."""
    language = S.language_of(F.col("file"), entrypoints=True)
    if "language" in nodes.columns:
        language = F.coalesce("language", language)
    name, kind = F.col("name"), F.col("kind")
    routine = kind.isin("Function", "Method")
    main = (
        F.when(language.isin("rust", "go", "c", "cpp"), (name == "main") & (kind == "Function"))
        .when(language.isin("java", "csharp", "kotlin"), (F.lower(name) == "main") & routine)
        .when(language == "python", name == "main")
        .otherwise((name == "main") & routine)
    )
    handler = (name.startswith("cmd_") | name.startswith("command_") | name.endswith("_cmd") | name.endswith("_command") | ((name == "run") & F.col("file").contains("cli"))) & routine
    rows = F.array(F.when(main, F.when(language == "python", "GuardedScript").otherwise("MainFunction")), F.when(handler, "CliCommand"))
    return nodes.where("kind <> 'File'").select("id", "qualified_name", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("entry"))


def overview(nodes: DataFrame, edges: DataFrame, ranks: DataFrame, communities: DataFrame, components: DataFrame) -> DataFrame:
    """(section, key, value) of a module-level overview: counts, languages, dependencies, central modules, cycles, communities."""
    p_nodes, p_edges = graphs.projected(nodes, edges, "module")
    text = lambda c: c.cast("string")
    files = nodes.agg(F.count_distinct("file").alias("n")).select(F.lit("count"), F.lit("files"), text(F.col("n")))
    symbols = nodes.where("kind <> 'File'").agg(F.count("*").alias("n")).select(F.lit("count"), F.lit("symbols"), text(F.col("n")))
    languages = nodes.groupBy(F.coalesce(S.language_of(F.col("file")), F.lit("other")).alias("l")).agg(F.count_distinct("file").alias("n")).select(F.lit("language"), "l", text(F.col("n")))
    entries = entrypoints(nodes).groupBy("entry").agg(F.count("*").alias("n")).select(F.lit("entrypoint"), "entry", text(F.col("n")))
    direction = p_edges.where("src <> dst").select(F.lit("dependency"), F.concat("src", F.lit(" -> "), "dst"), text(F.col("weight")))
    central = ranks.orderBy(F.desc("rank"), "id").limit(10).select(F.lit("central"), text(F.col("id")), text(F.round("rank", 6)))
    tangled = components.where("NOT trivial").groupBy("number").agg(F.count("*").alias("n")).select(F.lit("tangle"), text(F.col("number")), text(F.col("n")))
    groups = communities.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("community"), "label", text(F.col("n")))
    out = files.toDF("section", "key", "value")
    for part in (symbols, languages, entries, direction, central, tangled, groups):
        out = out.union(part)
    return out


def best_match(nodes: DataFrame, term: str) -> DataFrame:
    """The node that a name means: exact qualified name, then name, then the least id of what lookup finds."""
    from .queries import find

    tier = F.when(F.col("qualified_name") == term, 0).when(F.col("name") == term, 1).otherwise(2)
    return find(nodes, term).orderBy(tier, *S.unsigned_order("id")).limit(1)


def explore(nodes: DataFrame, edges: DataFrame, term: str, depth: int = 2, files: DataFrame | None = None) -> DataFrame:
    """(section, name, detail): target, callers, callees, impact counts and tests of a symbol.

    With ``files`` (path, content), and nodes with a ``location``, its source text
    too, unless that is empty.  A term that names nothing gives no rows.
    """
    from .context import slices, spans_of

    hit = best_match(nodes, term).first()
    schema = "section string, name string, detail string"
    if hit is None:
        return nodes.sparkSession.createDataFrame([], schema)
    near = neighbourhood(nodes, edges, hit["id"]).where("role IN ('caller', 'callee')").select(F.col("role").alias("section"), F.col("qualified_name").alias("name"), F.col("depth").cast("string").alias("detail"))
    counts = graphs.impact_counts(graphs.impact(nodes, edges, hit["id"], depth))
    hits = counts.select(F.explode(F.create_map(*(x for c in ("total", "direct", "transitive", "possible") for x in (F.lit(c), F.col(c)))))).select(F.lit("impact").alias("section"), F.col("key").alias("name"), F.col("value").cast("string").alias("detail"))
    found = discovered_tests(nodes, edges)
    tests = tests_of(found, hit["qualified_name"]).union(tests_of(found, hit["file"])).distinct().select(F.lit("test").alias("section"), "test_file", F.coalesce("test_symbol", F.lit("")))
    target = nodes.where(F.col("id") == hit["id"]).select(F.lit("target"), "qualified_name", F.concat("kind", F.lit(" in "), "file"))
    out = target.toDF("section", "name", "detail").union(near).union(hits).union(tests)
    if files is not None and "location" in nodes.columns:
        text = slices(spans_of(nodes.where(F.col("id") == hit["id"])), files).where("text <> ''")
        out = out.union(text.select(F.lit("source"), F.lit(hit["qualified_name"]), "text"))
    return out


def markdown(sections: DataFrame, title: str) -> str:
    """A report of (section, name, detail) rows, a heading a section; its rows fit on the driver as they are meant to be read."""
    lines, last = [f"# {title}"], None
    for section, name, detail in sections.orderBy(*sections.columns).collect():
        if section != last:
            lines += ["", f"## {section}", ""]
            last = section
        lines += [f"- {name}:", "", *(f"      {x}" for x in detail.split("\n"))] if "\n" in (detail or "") else [f"- {name}" + (f": {detail}" if detail else "")]
    return "\n".join(lines) + "\n"

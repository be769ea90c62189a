"""One object for a graph, a method an operator; all give DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import build, compare, context, export, graphs, incremental, intel, queries
from .operators import traverse as tr
from .sources import index_files, repo
from .sources.tables import Scope, cut


class CodeGraph:
    def __init__(self, nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None):
        self.nodes, self.edges, self.files = nodes, edges, files

    @classmethod
    def from_repo(cls, spark: SparkSession, root: str) -> CodeGraph:
        scanned = cut(repo.scan(spark, root))
        graph = cls.from_sources(repo.source_text(scanned))
        graph.scanned = scanned.drop("content")
        return graph

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> CodeGraph:
        """The stored index of a tree, a graph document, or else a build of the tree; damaged ones are an error."""
        built = []

        def build_now():
            built.append(cls.from_repo(spark, root))
            return built[0].nodes, built[0].edges

        nodes, edges, source = index_files.opened(spark, root, build_now)
        graph = built[0] if built else cls(nodes, edges).checked()
        graph.source = source
        return graph

    @classmethod
    def current(cls, spark: SparkSession, root: str) -> CodeGraph:
        """The stored index if it is that of the tree as it stands; else the tree is built and its index saved."""
        where = f"{root}/.graphloom/index"
        if index_files.state(spark, where, repo.scan(spark, root).drop("content"))[0] == index_files.CURRENT:
            return cls.load(spark, where)
        graph = cls.from_repo(spark, root)
        graph.save(where)
        return graph

    @classmethod
    def from_sources(cls, sources: DataFrame) -> CodeGraph:
        """``sources`` has (path, language, text)."""
        from .sources.extract import extracted

        records = cut(extracted(sources))
        files = cut(sources.select("path", "language", "text"))
        nodes, edges, resolved = incremental.built(files, records)
        graph = cls(nodes, edges, files.select("path", F.col("text").alias("content")))
        graph.records, graph.resolved = records, resolved
        return graph

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CodeGraph:
        """What :meth:`save` wrote; broken invariants are an error."""
        tables = index_files.load(spark, path)
        return cls(tables["nodes"], tables["edges"]).checked()

    def checked(self) -> CodeGraph:
        broken = build.invalid(self.nodes, self.edges).collect()  # six rows at most
        if broken:
            raise ValueError("; ".join(f"{r['rule']}: {r['n']}" for r in broken))
        return self

    def save(self, path: str) -> None:
        """An index of the graph, with the files and records that it was built from if they are at hand."""
        more = {"files": getattr(self, "scanned", None), "records": getattr(self, "records", None)}
        index_files.save(path, {"nodes": self.nodes, "edges": self.edges} | {k: df for k, df in more.items() if df is not None})

    def projected(self, level: str = "file", kinds=None):
        return graphs.projected(self.nodes, self.edges, level, kinds)

    def ranks(self, level: str = "file", kinds=None) -> DataFrame:
        p_nodes, p_edges = self.projected(level, kinds)
        return tr.pagerank(p_edges, ids=p_nodes.select("id"))

    @cached_property
    def symbol_ranks(self) -> DataFrame:
        return cut(self.ranks("symbol"), lasting=True)

    def limited(self, seconds: float | None = None) -> Scope:
        """``with graph.limited(30) as s: graph.impact(...)``: work that ends by then, or by ``s.cancel()`` from another thread."""
        return Scope(self.nodes.sparkSession, seconds)

    def components(self, level: str = "file", kinds=None) -> DataFrame:
        p_nodes, p_edges = self.projected(level, kinds)
        found = tr.strong_components(p_edges.where("src <> dst"))
        alone = p_nodes.select("id").join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("component_id"), F.lit(1).cast("long").alias("size"))
        return graphs.component_ids(found.union(alone), p_edges)

    def analyze(self, level: str = "file", kinds=None, limit: int | None = None) -> dict[str, DataFrame]:
        """Components, cycles, centrality, coupling, hotspots and communities over one projection; each list cut to ``limit`` after it is whole."""
        p_nodes, p_edges = (cut(x) for x in self.projected(level, kinds))
        found = tr.strong_components(p_edges.where("src <> dst"))
        alone = p_nodes.select("id").join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("component_id"), F.lit(1).cast("long").alias("size"))
        comp = cut(graphs.component_ids(found.union(alone), p_edges))
        ranks = cut(tr.pagerank(p_edges, ids=p_nodes.select("id")))
        labels = cut(graphs.communities(p_nodes, p_edges))
        out = {
            "components": comp.orderBy("number", "id"),
            "cycles": graphs.cycles(p_edges, comp),
            "centrality": graphs.degrees(p_nodes, p_edges).join(ranks, "id").orderBy(F.desc("rank"), F.desc("total_degree"), "id"),
            "coupling": queries.coupling(p_nodes, p_edges).orderBy(F.desc("afferent"), F.desc("efferent"), "id"),
            "hotspots": graphs.hotspots(p_nodes, p_edges, ranks, comp).orderBy(F.desc("score"), F.desc("fan_in"), F.desc("fan_out"), "id"),
            "communities": graphs.community_report(labels, p_edges).orderBy("number"),
        }
        return {k: df.limit(limit) for k, df in out.items()} if limit is not None else out

    def report(self, limit: int = 10) -> str:
        """Audit at module level as Markdown."""
        parts = self.analyze("module", limit=limit)
        text = None
        for name, df in parts.items():
            some = df.select(F.lit(name).alias("section"), F.col(df.columns[0]).cast("string").alias("name"), F.to_json(F.struct(*df.columns[1:])).alias("detail"))
            text = some if text is None else text.union(some)
        return intel.markdown(text, "Graph report")

    def stats(self) -> DataFrame:
        return self.nodes.groupBy(F.lit("node").alias("what"), "kind").agg(F.count("*").alias("n")).union(self.edges.groupBy(F.lit("edge"), "kind").agg(F.count("*")))

    def find(self, term: str) -> DataFrame:
        return queries.find(self.nodes, term)

    def symbol(self, term: str) -> DataFrame:
        return intel.explained(self.nodes, self.edges).join(self.find(term).select("id"), "id", "left_semi")

    def search(self, term: str, kind=None, file=None, limit=None) -> DataFrame:
        return intel.ranked_search(self.nodes, term, self.symbol_ranks if term.strip() else None, kind, file, limit)

    def _sole(self, term: str) -> int:
        hit = [r["id"] for r in self.find(term).select("id").limit(2).collect()]
        if len(hit) != 1:
            raise ValueError(f"{term!r} means {'nothing' if not hit else 'several nodes'}")
        return hit[0]

    def path(self, start: str, goal: str, max_depth: int = 20, max_visited: int | None = 10_000) -> DataFrame:
        return graphs.shortest_path(self.edges, self._sole(start), self._sole(goal), max_depth, max_visited)

    def _first(self, term: str) -> int | None:
        row = intel.best_match(self.nodes, term).first()
        return row and row["id"]

    def callers(self, term: str, depth: int = 1, limit: int | None = 50) -> DataFrame:
        return graphs.k_hop(self.nodes, self.edges, self._first(term), "Calls", depth, True, limit)

    def callees(self, term: str, depth: int = 1, limit: int | None = 50) -> DataFrame:
        return graphs.k_hop(self.nodes, self.edges, self._first(term), "Calls", depth, False, limit)

    def references(self, term: str) -> DataFrame:
        return intel.references(self.nodes, self.edges, self._first(term))

    def neighbourhood(self, term: str, depth: int = 1, limit: int | None = None) -> DataFrame:
        return intel.neighbourhood(self.nodes, self.edges, self._first(term), depth, limit)

    def impact(self, term: str, depth: int = 3) -> DataFrame:
        return graphs.impact(self.nodes, self.edges, self._first(term), depth)

    def tests(self, term: str | None = None) -> DataFrame:
        found = intel.discovered_tests(self.nodes, self.edges)
        return found if term is None else intel.tests_of(found, term)

    def entrypoints(self) -> DataFrame:
        return intel.entrypoints(self.nodes)

    def architecture(self) -> DataFrame:
        p_nodes, p_edges = self.projected("module")
        return intel.overview(self.nodes, self.edges, self.ranks("module"), graphs.communities(p_nodes, p_edges), self.components("module"))

    def explore(self, term: str, depth: int = 2) -> str:
        return intel.markdown(intel.explore(self.nodes, self.edges, term, depth, self.files), term)

    def context(self, symbol=None, file=None, query=None, changed=None, limit: int = 8000, max_depth: int = 3, max_candidates: int = 100) -> DataFrame:
        start = context.seeds(self.nodes, symbol, file, query, changed, self.symbol_ranks if query else None)
        return context.context(self.nodes, self.edges, self.files, start, limit, max_depth, max_candidates)

    def dead_code(self) -> DataFrame:
        return queries.unreferenced(self.nodes, self.edges)

    def layers(self, rules) -> DataFrame:
        return compare.violations(self.nodes, self.edges, rules)

    def call_graph(self) -> DataFrame:
        return compare.refined_calls(self.nodes, self.edges)

    def diff(self, old: CodeGraph) -> dict[str, DataFrame]:
        return {"nodes": compare.node_diff(old.nodes, self.nodes), "edges": compare.edge_diff(old.nodes, old.edges, self.nodes, self.edges), "api": compare.api_diff(old.nodes, self.nodes)}

    def export(self, name: str) -> DataFrame:
        return export.exported(self.nodes, self.edges, name)

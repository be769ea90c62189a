"""Kept records, incremental builds and what a change affects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import extract
from ..sources.tables import cut
from . import build, graphs
from .compare import file_changes


def updated_records(files: DataFrame, kept_files: DataFrame | None, kept_records: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(records, changes): only added or modified files are read again, the records of unchanged ones are kept.

    ``files`` has (path, language, text, hash, parser_version); kept tables are those of
    the build before, or None.
    """
    text = files.where("language IS NOT NULL")
    if kept_files is None or kept_records is None:
        return extract.extracted(text), files.select("path", F.lit("Added").alias("change"))
    changes = cut(file_changes(kept_files, files))
    fresh = text.join(changes.where("change IN ('Added', 'Modified')").select("path"), "path", "left_semi")
    same = changes.where("change = 'Unchanged'").select(F.col("path").alias("file"))
    return kept_records.join(same, "file", "left_semi").unionByName(extract.extracted(fresh.select("path", "language", "text"))), changes


def built(files: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, resolution) of files and their records."""
    nodes = cut(build.nodes_of(files.select("path", "language"), records))
    resolved = cut(build.resolution(files, records, nodes))
    return nodes, cut(build.edges_of(files, records, nodes, resolved)), resolved


def providers(records: DataFrame) -> DataFrame:
    """(name, file): who defines or exports a name."""
    return records.where("record IN ('symbol', 'export')").select("name", "file").distinct()


def waiting(resolved: DataFrame) -> DataFrame:
    """(edge, name, file): references that found no target."""
    return resolved.where("state <> 'Resolved'").select("edge", "name", "file").distinct()


def dependency_hints(records: DataFrame, changed: DataFrame) -> DataFrame:
    """Files (id) that define a name which a changed file (path) uses."""
    of = changed.select(F.col("path").alias("file"))
    used = records.where("record IN ('call', 'reference', 'type', 'instantiation')").join(of, "file", "left_semi").select("name").distinct()
    return providers(records).join(used, "name", "left_semi").select(F.col("file").alias("id")).distinct()


def reverse_hints(old_records: DataFrame, new_records: DataFrame, resolved: DataFrame, changed: DataFrame) -> DataFrame:
    """Files (id) whose references name what changed files defined before or define now."""
    of = changed.select(F.col("path").alias("file"))
    names = providers(old_records).union(providers(new_records)).join(of, "file", "left_semi").select("name").distinct()
    return resolved.join(names, "name", "left_semi").select(F.col("file").alias("id")).distinct()


def affected(nodes: DataFrame, edges: DataFrame, changed: DataFrame, whole_component: bool = False) -> DataFrame:
    """Files (id) that depend on changed files (path) over imports and types, or all that are connected with them."""
    file_of = nodes.select("id", "file")
    some = edges.where("kind <> 'Contains'") if whole_component else edges.where("kind IN ('Imports', 'TypeReferences', 'Inherits', 'Implements')")
    links = some.join(file_of.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(file_of.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst")
    return graphs.closure(links.select(F.col("b").alias("src"), F.col("a").alias("dst")).where("src <> dst").distinct(), changed.select(F.col("path").alias("id")), undirected=whole_component)


def mutation_files(component: DataFrame, hints: DataFrame, reverse: DataFrame, changed: DataFrame) -> DataFrame:
    """component - hints - reverse + changed, all (id)."""
    rest = component.join(hints, "id", "left_anti").join(reverse, "id", "left_anti")
    return rest.union(changed.select(F.col("path").alias("id"))).distinct()


def selective_edges(files: DataFrame, records: DataFrame, nodes: DataFrame, edges: DataFrame, touched: DataFrame) -> DataFrame:
    """Edges after references of the touched files (id) are resolved again; all others stay, if their ends do.

    ``nodes`` is the new table, ``edges`` the old one.
    """
    of = touched.select(F.col("id").alias("file"))
    file_of = nodes.select("id", "file")
    mine = file_of.join(of, "file", "left_semi").select(F.col("id").alias("src"))
    kept = edges.join(mine, "src", "left_anti")
    for end in ("src", "dst"):
        kept = kept.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    fresh = build.edges_of(files, records.join(of, "file", "left_semi").unionByName(records.join(of, "file", "left_anti").where("record = 'symbol'")), nodes, build.resolution(files, records, nodes).join(of, "file", "left_semi"))
    fresh = fresh.join(mine, "src", "left_semi")
    return kept.select(*edges.columns).union(fresh.select(*edges.columns)).dropDuplicates(["id"])

"""Graphs as text: one row a line or element, in order by ``(part, at)``; files of any size are written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schema as S
from . import ranks

ROUTINES, HOLDERS = ("Function", "Method", "Constructor"), ("Module", "Package", "Namespace")
# Shape, fill and text colour of kinds of nodes, colour and style of kinds of edges.
DOT_NODES = [(("Struct", "Class"), "box", "#dbeafe", "#1e3a8a"), (("Trait", "Interface"), "diamond", "#ede9fe", "#5b21b6"), (("Enum",), "hexagon", "#fef3c7", "#92400e"), (ROUTINES, "ellipse", "#d1fae5", "#065f46"), (HOLDERS, "folder", "#ffedd5", "#9a3412"), (("File",), "note", "#e5e7eb", "#374151")]
DOT_EDGES = [(("Calls",), "#2563eb", "solid"), (("Imports",), "#4b5563", "dashed"), (("Contains",), "#9ca3af", "dotted"), (("Implements",), "#059669", "bold"), (("Inherits",), "#7c3aed", "bold"), (("References", "TypeReferences"), "#d97706", "dashed"), (("Instantiates",), "#dc2626", "solid"), (("Exports",), "#0891b2", "solid")]
MERMAID_ARROWS = [(("Calls",), "-->|calls|"), (("Implements",), "==>|implements|"), (("Inherits",), "==>|inherits|"), (("Imports",), "-.->|imports|"), (("Contains",), "-->|contains|"), (("References", "TypeReferences"), "-.->|refs|"), (("Instantiates",), "-->|creates|"), (("Exports",), "-->|exports|")]


def choose(kind: Column, table, place: int, default: str = "") -> Column:
    out = None
    for row in table:
        out = F.when(kind.isin(*row[0]), row[place]) if out is None else out.when(kind.isin(*row[0]), row[place])
    return out.otherwise(default)


def number(c: str) -> Column:
    return S.unsigned(F.col(c)).cast("string")


def _lines(df: DataFrame, part: int, text: Column, *order) -> DataFrame:
    return df.select(F.lit(part).alias("part"), F.concat_ws("\0", *(F.lpad(F.col(c).cast("string"), 40, "0") if c in ("id", "src", "dst") else F.col(c).cast("string") for c in order)).alias("at"), text.alias("line"))


def _fixed(df: DataFrame, part: int, lines: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(part, f"{i:06d}", x) for i, x in enumerate(lines)], "part int, at string, line string")


def with_labels(edges: DataFrame) -> DataFrame:
    for c in ("label", "confidence"):
        if c not in edges.columns:
            edges = edges.withColumn(c, F.lit(None).cast("string"))
    return edges if "id" in edges.columns else edges.withColumn("id", F.xxhash64("kind", "src", "dst", "label"))


def dot(nodes: DataFrame, edges: DataFrame, name: str = "code") -> DataFrame:
    head = _fixed(nodes, 0, [f"digraph {name} {{", "  rankdir=LR;", "  compound=true;", '  node [fontsize=10, fontname="Helvetica", shape=ellipse, style=filled, fillcolor="#f3f4f6"];', '  edge [fontsize=8, fontname="Helvetica", color="#4b5563"];', ""])
    k = F.col("kind")
    label = F.concat(S.escape_dot(F.col("name")), F.lit("\\n["), k, F.lit("]\\n"), S.escape_dot(F.col("file")))
    n = F.concat(F.lit("  node_"), number("id"), F.lit(' [label="'), label, F.lit('", shape='), choose(k, DOT_NODES, 1, "ellipse"), F.lit(', fillcolor="'), choose(k, DOT_NODES, 2, "#f3f4f6"), F.lit('", fontcolor="'), choose(k, DOT_NODES, 3, "#1f2937"), F.lit('"];'))
    e = F.concat(F.lit("  node_"), number("src"), F.lit(" -> node_"), number("dst"), F.lit(' [label="'), S.escape_dot(F.coalesce("label", "kind")), F.lit('", color="'), choose(k, DOT_EDGES, 1), F.lit('", style='), choose(k, DOT_EDGES, 2), F.lit("];"))
    return head.union(_lines(nodes, 1, n, "qualified_name", "id")).union(_fixed(nodes, 2, [""])).union(_lines(with_labels(edges), 3, e, "kind", "src", "dst")).union(_fixed(nodes, 4, ["}"]))


def top_nodes(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """The nodes (id) with most edge ends."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id", "qualified_name").join(ends, "id", "left").orderBy(F.desc(F.coalesce("degree", F.lit(0))), "qualified_name", "id").limit(limit).select("id")


def mermaid(nodes: DataFrame, edges: DataFrame, max_nodes: int | None = None) -> DataFrame:
    if max_nodes is not None:
        some = top_nodes(nodes, edges, max_nodes)
        nodes = nodes.join(some, "id", "left_semi")
        edges = edges.join(some.select(F.col("id").alias("src")), "src", "left_semi").join(some.select(F.col("id").alias("dst")), "dst", "left_semi")
    k = F.col("kind")
    text = F.concat(F.lit('"'), k, F.lit(": "), S.escape_mermaid(F.col("name")), F.lit('"'))
    shape = F.when(k.isin("Struct", "Class"), F.concat(F.lit("[["), text, F.lit("]]"))).when(k.isin("Trait", "Interface"), F.concat(F.lit("{"), text, F.lit("}"))).when(k == "Enum", F.concat(F.lit("[\\"), text, F.lit("/]"))).when(k.isin(*ROUTINES), F.concat(F.lit("(["), text, F.lit("])"))).when(k.isin(*HOLDERS), F.concat(F.lit("[/"), text, F.lit("/]"))).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    files = ranks.numbered(nodes.select("file").distinct(), "file", name="n", start=1)
    begin = files.select(F.lit(1).alias("part"), F.concat_ws("\0", "file", F.lit("0")).alias("at"), F.concat(F.lit("  subgraph sub_"), F.col("n").cast("string"), F.lit(' ["'), S.escape_mermaid(F.col("file")), F.lit('"]')).alias("line"))
    inside = nodes.select(F.lit(1), F.concat_ws("\0", "file", F.lit("1"), "qualified_name", number("id")), F.concat(F.lit("    node_"), number("id"), shape))
    end = files.select(F.lit(1), F.concat_ws("\0", "file", F.lit("2")), F.lit("  end"))
    e = F.concat(F.lit("  node_"), number("src"), F.lit(" "), choose(k, MERMAID_ARROWS, 1), F.lit(" node_"), number("dst"))
    return _fixed(nodes, 0, ["flowchart TD"]).union(begin).union(inside).union(end).union(_lines(edges, 2, e, "kind", "src", "dst"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'  <key id="{i}" for="{f}" attr.name="{n}" attr.type="string"/>' for i, f, n in (("d_name", "node", "name"), ("d_kind", "node", "kind"), ("d_file", "node", "file"), ("d_lang", "node", "language"), ("d_sig", "node", "signature"), ("e_kind", "edge", "kind"), ("e_conf", "edge", "confidence"), ("e_label", "edge", "label"))]
    data = lambda key, c: F.when(c.isNotNull(), F.concat(F.lit(f'<data key="{key}">'), S.escape_xml(c), F.lit("</data>"))).otherwise("")
    optional = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    n = F.concat(F.lit('    <node id="n'), number("id"), F.lit('">'), data("d_name", F.col("name")), data("d_kind", F.col("kind")), data("d_file", F.col("file")), data("d_lang", optional(nodes, "language")), data("d_sig", optional(nodes, "signature")), F.lit("</node>"))
    edges = with_labels(edges)
    e = F.concat(F.lit('    <edge id="e'), number("id"), F.lit('" source="n'), number("src"), F.lit('" target="n'), number("dst"), F.lit('">'), data("e_kind", F.col("kind")), data("e_conf", F.col("confidence")), data("e_label", F.col("label")), F.lit("</edge>"))
    return _fixed(nodes, 0, [*head, '  <graph id="code" edgedefault="directed">']).union(_lines(nodes, 1, n, "qualified_name", "id")).union(_lines(edges, 2, e, "kind", "src", "dst")).union(_fixed(nodes, 3, ["  </graph>", "</graphml>"]))


def gexf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">', '  <graph mode="static" defaultedgetype="directed">', '    <attributes class="node">']
    head += [f'      <attribute id="{i}" title="{t}" type="string"/>' for i, t in enumerate(("kind", "file", "language"))] + ["    </attributes>", "    <nodes>"]
    value = lambda i, c: F.when(c.isNotNull(), F.concat(F.lit(f'<attvalue for="{i}" value="'), S.escape_xml(c), F.lit('"/>'))).otherwise("")
    language = F.col("language") if "language" in nodes.columns else F.lit(None).cast("string")
    n = F.concat(F.lit('      <node id="'), number("id"), F.lit('" label="'), S.escape_xml(F.col("name")), F.lit('"><attvalues>'), value(0, F.col("kind")), value(1, F.col("file")), value(2, language), F.lit("</attvalues></node>"))
    edges = with_labels(edges)
    e = F.concat(F.lit('      <edge id="'), number("id"), F.lit('" source="'), number("src"), F.lit('" target="'), number("dst"), F.lit('" label="'), S.escape_xml(F.col("kind")), F.lit('"/>'))
    return _fixed(nodes, 0, head).union(_lines(nodes, 1, n, "qualified_name", "id")).union(_fixed(nodes, 2, ["    </nodes>", "    <edges>"])).union(_lines(edges, 3, e, "kind", "src", "dst")).union(_fixed(nodes, 4, ["    </edges>", "  </graph>", "</gexf>"]))


def _json(df: DataFrame, cols: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in cols.items())), {"ignoreNullFields": "false"})


def cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Elements as JSON lines: (part 1) nodes, (part 2) edges."""
    optional = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("string")
    n = F.to_json(F.struct(F.struct(number("id").alias("id"), "name", "qualified_name", "kind", "file", optional("language").alias("language"), optional("signature").alias("signature"), optional("container").alias("container")).alias("data")), {"ignoreNullFields": "false"})
    edges = with_labels(edges)
    e = F.to_json(F.struct(F.struct(F.concat(F.lit("e_"), number("id")).alias("id"), number("src").alias("source"), number("dst").alias("target"), "kind", "confidence", "label").alias("data")), {"ignoreNullFields": "false"})
    return _lines(nodes, 1, n, "qualified_name", "id").union(_lines(edges, 2, e, "kind", "src", "dst"))


def json_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Canonical JSON lines of nodes, then edges; null fields are left out."""
    n, e = F.to_json(F.struct(*nodes.columns)), F.to_json(F.struct(*edges.columns))
    return _lines(nodes, 1, n, "qualified_name", "kind", "id").union(_lines(edges, 2, e, "kind", "src", "dst"))


def vault(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Notes (path, text): one a file and one a symbol, with links both ways; symbols of one kind and name share a note, the last wins."""
    of = nodes.select("id", "kind", "name", "file", "qualified_name", F.concat("kind", F.lit("_"), S.file_name(F.col("name"))).alias("note"))
    out = edges.join(of.select(F.col("id").alias("dst"), F.col("note").alias("to")), "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("- "), "kind", F.lit(" [["), "to", F.lit("]]")))).alias("outbound"))
    inn = edges.join(of.select(F.col("id").alias("src"), F.col("note").alias("by")), "src").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("- "), "kind", F.lit(" [["), "by", F.lit("]]")))).alias("inbound"))
    block = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n## {title}\n\n"), F.array_join(c, "\n"), F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("# "), "name", F.lit("\n\n"), "kind", F.lit(" in [["), S.file_name(F.col("file")), F.lit("]]\n"), block("Outbound", "outbound"), block("Inbound", "inbound"))
    symbols = of.where("kind <> 'File'").join(out, "id", "left").join(inn, "id", "left").select(F.concat(F.lit("symbols/"), "note", F.lit(".md")).alias("path"), "qualified_name", "id", text.alias("text"))
    symbols = symbols.groupBy("path").agg(F.max_by("text", F.struct("qualified_name", "id")).alias("text"))
    files = of.groupBy("file").agg(F.array_sort(F.collect_set(F.when(F.col("kind") != "File", F.concat(F.lit("- [["), "note", F.lit("]]"))))).alias("members"))
    files = files.select(F.concat(F.lit("files/"), S.file_name(F.col("file")), F.lit(".md")).alias("path"), F.concat(F.lit("# "), "file", F.lit("\n\n"), F.array_join("members", "\n"), F.lit("\n")).alias("text"))
    index = of.agg(F.count_if(F.col("kind") != "File").alias("s"), F.count_distinct("file").alias("f")).select(F.lit("index.md").alias("path"), F.concat(F.lit("# Index\n\n- symbols: "), F.col("s").cast("string"), F.lit("\n- files: "), F.col("f").cast("string"), F.lit("\n")).alias("text"))
    return symbols.union(files).union(index)


#: Formats by name and alias.
FORMATS = {"json": json_graph, "dot": dot, "graphviz": dot, "mermaid": mermaid, "mmd": mermaid, "graphml": graphml, "gexf": gexf, "gephi": gexf, "cytoscape": cytoscape, "cyto": cytoscape, "obsidian": vault, "vault": vault}


def exported(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    if name.lower() not in FORMATS:
        raise ValueError(f"unknown format {name}; known: {', '.join(sorted(FORMATS))}")
    return FORMATS[name.lower()](nodes, edges)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in order, one file a range of them."""
    lines.repartitionByRange("part", "at").sortWithinPartitions("part", "at").select("line").write.text(path)


def write_notes(notes: DataFrame, path: str) -> DataFrame:
    """One file a note, written where the rows are; returns (path) of those written."""

    def put(batches):
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                files, at = fs.FileSystem.from_uri(f"{path}/{name}")
                files.create_dir(at.rpartition("/")[0], recursive=True)
                with files.open_output_stream(at) as f:
                    f.write(text.encode("utf-8"))
            yield pa.RecordBatch.from_arrays([b.column(0)], ["path"])

    return notes.select("path", "text").mapInArrow(put, "path string")

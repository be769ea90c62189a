"""Queries of index files and byte spans, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import intel
from ..sources import index_files
from ..sources import tables as src
from .wide import _W


def _index(spark: SparkSession, sf_dir: str) -> str:
    where = src.fresh_path(spark, "index")
    index_files.save(where, {"nodes": src.whole_nodes(spark, sf_dir), "edges": src.whole_edges(spark, sf_dir)})
    return where


def indexed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes, written as an index and read back from its sections."""
    return index_files.load(spark, _index(spark, sf_dir))["nodes"].select("id", "kind", "name", "qualified_name", "file")


def indexed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of an index by kind and target: two reads by kinds, which open each section once."""
    where = _index(spark, sf_dir)
    edges = index_files.load(spark, where, {"edges": ("Calls", "Contains")})["edges"]
    others = index_files.load(spark, where, {"edges": ("Imports", "References", "Instantiates", "Implements")})["edges"]
    every = edges.union(others)
    return every.groupBy("kind", "dst").agg(F.count("*").alias("n"), F.sum("src").alias("sources"))


def byte_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle third of every document's bytes, cuts inside letters moved to their edges."""
    d = src.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text")
    d = d.withColumn("part", T.byte_cut(F.col("text"), (size / 3).cast("int"), (size * 2 / 3).cast("int")))
    return d.select("doc_id", F.sha2("part", 256).alias("hash"), F.octet_length("part").cast("long").alias("bytes"), F.length("part").cast("long").alias("characters"))


def flow_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span over one or two lines of every document, empty where it cuts a letter or begins beyond the text."""
    d = src.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    line = F.expr("int(doc_id % 5) + 1")
    part = T.span_text(F.col("text"), line, F.expr("int(doc_id % 40) + 1"), line + F.expr("int(doc_id % 2)"), F.expr("int(doc_id % 97) + 1"))
    return d.select("doc_id", F.hex(F.encode(part, "UTF-8")).alias("bytes"))


def _test_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File nodes of customers, nations and regions; some are tests, with stems longer or shorter than those of sources."""
    t = lambda n: src.table(spark, sf_dir, n)
    key = F.concat(F.lit("k"), F.col("c_custkey") + 100_000)
    file = lambda df, *c: df.select(F.concat(*c).alias("file"))
    parts = [
        file(t("customer"), F.lit("s/n"), "c_nationkey", key, F.lit(".go")),
        file(t("customer").where("c_custkey % 3 = 0"), F.lit("t/"), key, F.lit("_test.go")),
        file(t("customer").where("c_custkey % 3 = 1"), F.lit("t/more_n"), "c_nationkey", key, F.lit("_test.go")),
        file(t("nation"), F.lit("t/"), F.lower("n_name"), F.lit("_test.go")),
        file(t("region"), F.lit("s/"), F.lower(F.substring("r_name", 1, 2)), F.lit(".go")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.select(F.xxhash64("file").alias("id"), F.lit("File").alias("kind"), F.col("file").alias("name"), F.col("file").alias("qualified_name"), "file")


def tests_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files and tests of which one stem contains the other."""
    none = spark.createDataFrame([], "kind string, src long, dst long")
    return intel.discovered_tests(_test_files(spark, sf_dir), none).select("source_file", "test_file", "reason")


_STEMS = (
    "WITH c AS (SELECT c_custkey AS n, c_nationkey || 'k' || (c_custkey + 100000) AS key FROM customer)"
    ", t AS (SELECT 't/k' || (n + 100000) || '_test.go' AS file, 'k' || (n + 100000) AS stem FROM c WHERE n % 3 = 0 UNION ALL SELECT 't/more_n' || key || '_test.go', 'more_n' || key FROM c WHERE n % 3 = 1 UNION ALL SELECT 't/' || lower(n_name) || '_test.go', lower(n_name) FROM nation)"
    ", s AS (SELECT 's/n' || key || '.go' AS file, 'n' || key AS stem FROM c UNION ALL SELECT 's/' || lower(r_name[1:2]) || '.go', lower(r_name[1:2]) FROM region)"
    " SELECT DISTINCT s.file AS source_file, t.file AS test_file, 'matching naming convention between ' || s.file || ' and ' || t.file AS reason FROM s JOIN t ON contains(s.stem, t.stem) OR contains(t.stem, s.stem)"
)
_CHARS = "d AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS size FROM documents), u AS (SELECT doc_id, size, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM d)"
_CHARS += ", p AS (SELECT *, sum(octet_length(encode(c))) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM u), k AS (SELECT doc_id, string_agg(c, '' ORDER BY i) AS part FROM p WHERE e <= size * 2 // 3 AND e - octet_length(encode(c)) >= size // 3 GROUP BY 1)"
_SPAN = "WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: octet_length(encode(x)) + 1) AS sizes, octet_length(encode(coalesce(text, ''))) AS size, (doc_id % 5 + 1)::INT AS l, (doc_id % 5 + 1 + doc_id % 2)::INT AS m FROM documents)"
_SPAN += ", o AS (SELECT *, l <= len(sizes) AS there, coalesce(list_sum(sizes[1:l - 1]), 0) + doc_id % 40 AS a0, least(CASE WHEN m <= len(sizes) THEN coalesce(list_sum(sizes[1:m - 1]), 0) ELSE size END + doc_id % 97, size) AS b FROM d), q AS (SELECT *, least(a0, b)::BIGINT AS a FROM o)"
_SPAN += " SELECT doc_id, CASE WHEN there AND NOT substr(hx, 2 * a + 1, 2) BETWEEN '80' AND 'BF' AND NOT substr(hx, 2 * b::BIGINT + 1, 2) BETWEEN '80' AND 'BF' THEN substr(hx, 2 * a + 1, 2 * (b - a)::BIGINT) ELSE '' END AS bytes FROM q"

QUERIES = {"indexed_nodes": indexed_nodes, "indexed_edges": indexed_edges, "byte_cuts": byte_cuts, "flow_spans": flow_spans, "tests_by_name": tests_by_name}

ORACLES = {
    "indexed_nodes": _W + "SELECT id, kind, name, qualified_name, file FROM wn",
    "indexed_edges": _W + "SELECT kind, dst, count(*) AS n, sum(src)::BIGINT AS sources FROM we GROUP BY 1, 2",
    "byte_cuts": f"WITH {_CHARS} SELECT d.doc_id, sha256(coalesce(part, '')) AS hash, octet_length(encode(coalesce(part, '')))::BIGINT AS bytes, length(coalesce(part, ''))::BIGINT AS characters FROM d LEFT JOIN k USING (doc_id)",
    "flow_spans": _SPAN,
    "tests_by_name": _STEMS,
}

"""Queries over the tables and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import approx_tokens, content_hash
from ..operators import queries as q
from ..operators import traverse as tr
from ..sources import tables as src

_G = """WITH home AS (SELECT n_nationkey k, 'r' || n_regionkey || '/n' || n_nationkey || '/' d FROM nation),
cu AS (SELECT customer.*, d || lower(c_mktsegment) || '.rs' f FROM customer JOIN home ON c_nationkey = k),
nodes AS (
 SELECT 10000000000 + r_regionkey id, 'Package' kind, r_name AS name, r_name AS qualified_name, 'r' || r_regionkey || '/package.rs' AS file FROM region
 UNION ALL SELECT 20000000000 + n_nationkey, 'Module', n_name, n_name, d || 'supply.rs' FROM nation JOIN home ON n_nationkey = k
 UNION ALL SELECT 30000000000 + c_custkey, 'Class', c_name, c_name, f FROM cu
 UNION ALL SELECT 40000000000 + s_suppkey, 'Interface', s_name, s_name, d || 'supply.rs' FROM supplier JOIN home ON s_nationkey = k
 UNION ALL SELECT 50000000000 + p_partkey, 'Function', p_name, p_name, 'parts/' || replace(lower(p_brand), '#', '_') || '.rs' FROM part
 UNION ALL SELECT 60000000000 + o_orderkey, 'Method', 'o' || o_orderkey, c_name || '::o' || o_orderkey, f FROM orders JOIN cu ON o_custkey = c_custkey),
edges AS (
 SELECT 'Calls' kind, 60000000000 + l_orderkey src, 50000000000 + l_partkey dst FROM lineitem
 UNION ALL SELECT DISTINCT 'References', 60000000000 + l_orderkey, 40000000000 + l_suppkey FROM lineitem
 UNION ALL SELECT 'Instantiates', 30000000000 + o_custkey, 60000000000 + o_orderkey FROM orders
 UNION ALL SELECT 'Implements', 30000000000 + c_custkey, 40000000000 + s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 100 = s_suppkey % 100),
trade AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) src, CAST(s_nationkey AS BIGINT) dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey <= 40 AND c_nationkey <> s_nationkey)
"""


def _projected(key: str) -> str:
    return _G + f""", k AS (SELECT id, {key} AS key FROM nodes), p AS (SELECT a.key src, b.key dst, count(*) weight, string_agg(DISTINCT kind, ',' ORDER BY kind) kinds FROM edges JOIN k a ON src = a.id JOIN k b ON dst = b.id GROUP BY 1, 2) """


_FILE = _projected("file")
_MODULE = _projected("CASE WHEN file LIKE '%/%' THEN regexp_replace(file, '/[^/]*$', '') ELSE '.' END")
_TERM = "o12"


def _project(level, edges=True):
    def run(s, d):
        return q.project(src.nodes(s, d), src.edges(s, d), level)[1 if edges else 0]

    return run


def _commits(s, d):
    li, o = src.table(s, d, "lineitem"), src.table(s, d, "orders")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("l_partkey").alias("file"))


def _diff(s, d):
    e = src.edges(s, d).where("kind = 'Instantiates'")
    key = F.col("dst") % src.SPAN
    return q.edge_diff(e.where(key % 7 != 0), e.where(key % 11 != 0))


def _diff_whole(s, d):
    """Snapshots by the residue of the order that an edge belongs to; edges without an order are in both."""
    e = src.edges(s, d)
    order = F.when(F.col("kind").isin("Calls", "References"), F.col("src")).when(F.col("kind") == "Instantiates", F.col("dst")) % src.SPAN
    held = lambda n: e.where(F.coalesce(order % n != 0, F.lit(True)))
    return q.edge_diff(held(7), held(11))


def _spans(s, d):
    li = src.table(s, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))


def _bursts(s, d):
    from ..streaming.debounce import bursts

    return bursts(src.table(s, d, "events").select(F.col("user_id").alias("path"), "ts"), "30 minutes")


def _impact(s, d):
    start = src.nodes(s, d).where("id = 50000000001").select("id")
    return tr.levels(src.edges(s, d), start, 3, reverse=True).where("depth > 0")


QUERIES = {
    "find_exact": lambda s, d: q.find(src.nodes(s, d), "o12"),
    "find_substring": lambda s, d: q.find(src.nodes(s, d), "::o12"),
    "search_ranked": lambda s, d: q.search(src.nodes(s, d), _TERM, 50).select("id", "qualified_name", "score"),
    "node_kinds": lambda s, d: q.histogram(src.nodes(s, d), "kind"),
    "edge_kinds": lambda s, d: q.histogram(src.edges(s, d), "kind"),
    "file_nodes": _project("file", False),
    "file_edges": _project("file"),
    "module_edges": _project("module"),
    "module_coupling": lambda s, d: q.coupling(*q.project(src.nodes(s, d), src.edges(s, d), "module")),
    "export_dot": lambda s, d: q.dot_lines(_project("module")(s, d)),
    "file_churn": lambda s, d: q.churn(_commits(s, d)),
    "change_coupling": lambda s, d: q.change_coupling(_commits(s, d), 0.0001),
    "dead_code": lambda s, d: q.dead_code(src.nodes(s, d), src.edges(s, d), ("Class", "Function", "Interface", "Method")).select("id", "kind", "qualified_name"),
    "edge_diff": _diff,
    "edge_diff_whole": _diff_whole,
    "overloads": lambda s, d: q.overloads(src.nodes(s, d).where("kind = 'Function'")).select("id", "overload"),
    "unenclosed_spans": lambda s, d: q.unenclosed(_spans(s, d)),
    "impact": _impact,
    "strong_components": lambda s, d: tr.strong_components(src.trade(s, d)),
    "strong_components_whole": lambda s, d: tr.strong_components(src.trade(s, d, None)),
    "pagerank": lambda s, d: tr.pagerank(src.trade(s, d, None).withColumn("weight", F.lit(1))),
    "source_metrics": lambda s, d: src.table(s, d, "documents").select("doc_id", approx_tokens(F.col("text")).alias("tokens"), F.octet_length("text").cast("long").alias("bytes"), content_hash(F.col("text")).alias("hash")),
    "change_bursts": _bursts,
}

_SCORE = "CASE WHEN lower(qualified_name) = 'o12' THEN 100 WHEN lower(name) = 'o12' THEN 80 WHEN starts_with(lower(name), 'o12') THEN 50 WHEN contains(lower(name), 'o12') OR contains(lower(qualified_name), 'o12') THEN 30 ELSE 0 END + CASE WHEN contains(lower(file), 'o12') THEN 15 ELSE 0 END"
_COMMITS = "WITH c AS (SELECT o_orderkey AS commit, o_custkey AS author, l_partkey AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"

#: Components of the whole trade, in a form that reaches nodes rather than paths.
_COMPONENTS_WHOLE = """WITH RECURSIVE t AS MATERIALIZED (SELECT DISTINCT CAST(c_nationkey AS BIGINT) src, CAST(s_nationkey AS BIGINT) dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey),
v AS (SELECT src id FROM t UNION SELECT dst FROM t), r(a, b) AS (SELECT id, id FROM v UNION SELECT a, dst FROM r JOIN t ON b = src),
c AS (SELECT x.a id, min(x.b) component_id FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1) SELECT id, component_id, count(*) OVER (PARTITION BY component_id) AS size FROM c"""

ORACLES = {
    "find_exact": _G + "SELECT * FROM nodes WHERE qualified_name = 'o12' OR name = 'o12' OR file = 'o12'",
    "find_substring": _G + "SELECT * FROM nodes WHERE contains(qualified_name, '::o12')",
    "search_ranked": _G + f"SELECT id, qualified_name, CAST({_SCORE} AS BIGINT) AS score FROM nodes WHERE {_SCORE} > 0 ORDER BY score DESC, qualified_name, id LIMIT 50",
    "node_kinds": _G + "SELECT kind, count(*) AS n FROM nodes GROUP BY 1",
    "edge_kinds": _G + "SELECT kind, count(*) AS n FROM edges GROUP BY 1",
    "file_nodes": _G + "SELECT file AS id, count(*) AS member_count FROM nodes GROUP BY 1",
    "file_edges": _FILE + "SELECT * FROM p",
    "module_edges": _MODULE + "SELECT * FROM p",
    "module_coupling": _MODULE + ", m AS (SELECT DISTINCT key FROM k), i AS (SELECT dst, count(*) n FROM p GROUP BY 1), o AS (SELECT src, count(*) n FROM p GROUP BY 1) SELECT key AS id, coalesce(i.n, 0) AS afferent, coalesce(o.n, 0) AS efferent, CASE WHEN coalesce(i.n, 0) + coalesce(o.n, 0) = 0 THEN 0.0::DOUBLE ELSE round(coalesce(o.n, 0)::DOUBLE / (coalesce(i.n, 0) + coalesce(o.n, 0)), 6) END AS instability FROM m LEFT JOIN i ON key = dst LEFT JOIN o ON key = src",
    "export_dot": _MODULE + """SELECT '"' || src || '" -> "' || dst || '" [label="' || kinds || '"];' AS line FROM p""",
    "file_churn": _COMMITS + " SELECT file, count(DISTINCT commit) AS commits, count(DISTINCT author) AS authors FROM c GROUP BY 1",
    "change_coupling": _COMMITS + ", u AS (SELECT DISTINCT commit, file FROM c), n AS (SELECT file, count(*) n FROM u GROUP BY 1), p AS (SELECT x.file a, y.file b, count(*) co FROM u x JOIN u y ON x.commit = y.commit AND x.file < y.file GROUP BY 1, 2 HAVING count(*) >= 0.0001::DOUBLE * (SELECT count(DISTINCT commit) FROM u)) SELECT a AS file_a, b AS file_b, co AS co_commits, round(co::DOUBLE / na.n, 6) AS conf_a_b, round(co::DOUBLE / nb.n, 6) AS conf_b_a FROM p JOIN n na ON a = na.file JOIN n nb ON b = nb.file",
    "dead_code": _G + "SELECT id, kind, qualified_name FROM nodes WHERE kind IN ('Class', 'Function', 'Interface', 'Method') AND id NOT IN (SELECT dst FROM edges)",
    "edge_diff": _G + "SELECT kind, src, dst, 'added' AS change FROM edges WHERE kind = 'Instantiates' AND dst % 10000000000 % 7 = 0 AND dst % 10000000000 % 11 <> 0 UNION ALL SELECT kind, src, dst, 'removed' FROM edges WHERE kind = 'Instantiates' AND dst % 10000000000 % 7 <> 0 AND dst % 10000000000 % 11 = 0",
    "edge_diff_whole": _G
    + ", e AS (SELECT *, CASE kind WHEN 'Instantiates' THEN dst WHEN 'Implements' THEN NULL ELSE src END % 10000000000 AS o FROM edges), a AS (SELECT kind, src, dst FROM e WHERE o IS NULL OR o % 7 <> 0), b AS (SELECT kind, src, dst FROM e WHERE o IS NULL OR o % 11 <> 0) SELECT *, 'added' AS change FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.kind = b.kind AND a.src = b.src AND a.dst = b.dst) UNION ALL SELECT *, 'removed' FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.kind = b.kind AND a.src = b.src AND a.dst = b.dst)",
    "overloads": _G + "SELECT id, row_number() OVER (PARTITION BY file, name, kind ORDER BY qualified_name, id) - 1 AS overload FROM nodes WHERE kind = 'Function'",
    "unenclosed_spans": """WITH s AS (SELECT l_suppkey AS file, l_partkey AS start, l_partkey + l_quantity::BIGINT AS "end", l_orderkey * 10 + l_linenumber AS id FROM lineitem) SELECT a.* FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.file = a.file AND (b.start < a.start OR b.start = a.start AND (b."end" > a."end" OR b."end" = a."end" AND b.id < a.id)) AND b."end" >= a."end")""",
    "impact": _G.replace("WITH", "WITH RECURSIVE", 1) + ", r(id, depth) AS (SELECT 50000000001, 0 UNION SELECT src, depth + 1 FROM r JOIN edges ON dst = id WHERE depth < 3) SELECT id, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY id HAVING min(depth) > 0",
    "strong_components": _G.replace("WITH", "WITH RECURSIVE", 1) + ", v AS (SELECT src id FROM trade UNION SELECT dst FROM trade), r(a, b) AS (SELECT id, id FROM v UNION SELECT a, dst FROM r JOIN trade ON b = src), c AS (SELECT x.a id, min(x.b) component_id FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1) SELECT id, component_id, count(*) OVER (PARTITION BY component_id) AS size FROM c",
    "strong_components_whole": _COMPONENTS_WHOLE,
    "source_metrics": "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, sha256(text) AS hash FROM documents",
    "change_bursts": "WITH e AS (SELECT user_id AS path, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT path, ts, sum(fresh) OVER (PARTITION BY path ORDER BY ts) AS b FROM e) SELECT path, min(ts) AS started, count(*) AS changes FROM g GROUP BY path, b",
}

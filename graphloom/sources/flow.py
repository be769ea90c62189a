"""Local value flow of functions: parameters, bindings, assignments, returns, call arguments.

Python is read by ``ast``; for other languages simple ``a = b`` lines, ``return x``
and calls on plain names are read from the text of the function's span.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extract import KEYWORDS, blanked, records

FIELDS = ("file", "function", "kind", "variable", "source", "callee", "call", "position", "depth", "line")
SCHEMA = "file string, function string, kind string, variable string, source string, callee string, call string, position int, depth int, line int"


def python_flow(file: str, text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    rows: list[tuple] = []
    put = lambda fn, kind, line, variable=None, source=None, callee=None, call=None, position=None, depth=0: rows.append((file, fn, kind, variable, source, callee, call, position, depth, line))
    names = lambda e: [n.id for n in ast.walk(e) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)]
    last = lambda f: f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None

    def calls(fn: str, e, assigned, depth: int) -> None:
        for c in ast.walk(e):
            if isinstance(c, ast.Call) and (callee := last(c.func)):
                key = f"{file}:{c.lineno}:{c.col_offset}"
                put(fn, "call", c.lineno, assigned if c is e else None, None, callee, key, None, depth)
                for i, a in enumerate(c.args):
                    for v in names(a):
                        put(fn, "argument", c.lineno, v, None, callee, key, i, depth)

    def walk(fn: str, body, depth: int) -> None:
        for s in body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                function(s)
                continue
            if isinstance(s, ast.ClassDef):
                walk(fn, s.body, depth)
                continue
            if isinstance(s, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and s.value is not None:
                targets = s.targets if isinstance(s, ast.Assign) else [s.target]
                into = [n.id for t in targets for n in ast.walk(t) if isinstance(n, ast.Name)]
                for v in into:
                    for source in names(s.value) or [None]:
                        put(fn, "assignment", s.lineno, v, source, depth=depth)
                calls(fn, s.value, into[0] if len(into) == 1 else None, depth)
            elif isinstance(s, ast.Return) and s.value is not None:
                for v in names(s.value):
                    put(fn, "return", s.lineno, v, depth=depth)
                calls(fn, s.value, None, depth)
            elif isinstance(s, ast.Expr):
                calls(fn, s.value, None, depth)
            for part in ("body", "orelse", "finalbody"):
                if isinstance(getattr(s, part, None), list):
                    walk(fn, getattr(s, part), depth + 1)

    def function(n) -> None:
        for i, a in enumerate([*n.args.posonlyargs, *n.args.args]):
            put(n.name, "parameter", n.lineno, a.arg, position=i)
        walk(n.name, n.body, 0)

    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and not any(r[1] == n.name and r[9] == n.lineno for r in rows):
            function(n)
    return list(dict.fromkeys(rows))


def lexical_flow(file: str, language: str, text: str) -> list[tuple]:
    rows, lines = [], blanked(text, language).split("\n")
    word = r"[A-Za-z_$][\w$]*"
    for r in records(file, language, text):
        if r[2] != "symbol" or r[3] not in ("Function", "Method", "Constructor"):
            continue
        fn, first, last = r[4], r[12], r[14]
        for i, p in enumerate(re.findall(rf"({word})\s*(?=[:,)])|({word})\s*[,)]", (r[7] or "")[1:])):
            rows.append((file, fn, "parameter", p[0] or p[1], None, None, None, i, 0, first))
        depth = 0
        for no in range(first, min(last, len(lines)) + 1):
            line = lines[no - 1]
            for m in re.finditer(rf"({word})\s*(?::?=)(?!=)\s*({word})\s*(?=[;,)\n]|$)", line):
                rows.append((file, fn, "assignment", m[1], m[2], None, None, None, depth, no))
            for m in re.finditer(rf"\breturn\s+({word})\s*(?=;|$)", line):
                rows.append((file, fn, "return", m[1], None, None, None, None, depth, no))
            for m in re.finditer(rf"(?:({word})\s*:?=\s*)?({word})\(([^()]*)\)", line):
                if m[2] not in KEYWORDS and no != first:
                    key = f"{file}:{no}:{m.start(2)}"
                    rows.append((file, fn, "call", m[1], None, m[2], key, None, depth, no))
                    rows += [(file, fn, "argument", v.strip(), None, m[2], key, i, depth, no) for i, v in enumerate(m[3].split(",")) if re.fullmatch(word, v.strip())]
            depth += line.count("{") - line.count("}")
    return rows


def local_flow(sources: DataFrame) -> DataFrame:
    """Rows of every function of (path, language, text); ``depth`` is that of the enclosing blocks."""

    def run(batches):
        import pyarrow as pa

        kinds = dict.fromkeys(("position", "depth", "line"), pa.int32())
        for b in batches:
            rows = [r for path, language, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in (python_flow(path, text or "") if language == "python" else lexical_flow(path, language, text or "") if language else [])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(f, pa.string())) for f, c in zip(FIELDS, zip(*rows, strict=True), strict=True)], list(FIELDS))

    return sources.select("path", "language", "text").mapInArrow(run, SCHEMA)


def flow_edges(flow: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, kind, confidence) over variables ``function id:name``: within functions, into parameters, out of returns.

    A call goes where the Calls edge of its function and callee name goes, the
    first in the order of edges.
    """
    from ..operators.compare import call_flow

    fn = nodes.where("kind IN ('Function', 'Method', 'Constructor')").groupBy("file", F.col("name").alias("function")).agg(F.min_by("id", F.struct(F.col("id") < 0, F.col("id"))).alias("fid"))
    f = flow.join(fn, ["file", "function"])
    var = lambda owner, name: F.concat(F.col(owner).cast("string"), F.lit(":"), F.col(name))
    inner = f.where("kind = 'assignment' AND source IS NOT NULL").select(var("fid", "source").alias("src"), var("fid", "variable").alias("dst"), F.lit("assignment").alias("kind"), F.lit("Extracted").alias("confidence"))
    names = nodes.select(F.col("id").alias("dst"), F.col("name").alias("callee"))
    goes = edges.where("kind = 'Calls'").join(names, "dst").groupBy(F.col("src").alias("fid"), "callee").agg(F.min_by("dst", F.struct(F.col("dst") < 0, F.col("dst"))).alias("to"))
    calls = f.where("kind = 'call'").join(goes, ["fid", "callee"]).select("call", F.col("fid").alias("caller"), F.col("to").alias("callee"), var("fid", "variable").alias("assigned"))
    arguments = f.where("kind = 'argument'").select("call", "position", var("fid", "variable").alias("variable"))
    parameters = f.where("kind = 'parameter'").select(F.col("fid").alias("function"), "position", var("fid", "variable").alias("variable"))
    returns = f.where("kind = 'return'").select(F.col("fid").alias("function"), var("fid", "variable").alias("variable"))
    return inner.union(call_flow(calls, arguments, parameters, returns)).distinct()

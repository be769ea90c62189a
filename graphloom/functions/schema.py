"""Fixed values of the graph model, identifiers and predicates, all as JVM-side expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The codes give the sort order of kinds, and enter identifiers by name.
NODE_KINDS = ("File", "Module", "Package", "Namespace", "Function", "Method", "Constructor", "Class", "Struct", "Trait", "Interface", "Enum", "Variable", "Constant", "Field", "Property", "TypeAlias")
EDGE_KINDS = ("Contains", "Imports", "Exports", "Calls", "References", "TypeReferences", "Instantiates", "Inherits", "Implements")
CONFIDENCES = ("Extracted", "Resolved", "Inferred", "Possible")
VISIBILITIES = ("public", "protected", "private", "internal", "package", "unknown")
LANGUAGES = ("rust", "python", "typescript", "javascript", "tsx", "jsx", "go", "c", "cpp", "java", "csharp", "kotlin", "zig", "php", "ruby", "swift")
# Languages by file extension.
EXTENSIONS = {
    "rs": "rust", "py": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "tsx": "tsx", "jsx": "jsx", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp",
    "java": "java", "cs": "csharp", "kt": "kotlin", "kts": "kotlin", "zig": "zig",
    "php": "php", "phtml": "php", "php3": "php", "php4": "php", "php5": "php", "php7": "php", "phps": "php", "rb": "ruby", "erb": "ruby", "swift": "swift",
}
#: Extensions that the detector of entry points does not know.
NOT_FOR_ENTRYPOINTS = frozenset({"hxx", "hh", "phtml", "php3", "php4", "php5", "php7", "phps", "erb"})
# Substrings that make a header C++.
CPP_MARKS = ("class ", "namespace ", "template<", "template <", "public:", "private:", "protected:", "std::", "using namespace ", "#include <iostream>", "#include <vector>", "#include <string>")
# Directories that a scan does not enter, and that of our own index.
EXCLUDED_DIRS = (".git", "target", "node_modules", "dist", "build", "__pycache__", ".venv", "venv", ".mypy_cache", ".pytest_cache", "vendor", ".next", "out", "coverage", ".tox", ".eggs", ".graphloom")
# Endings of test files.
TEST_SUFFIXES = (
    "_test.rs", "_test.go", "_test.py", ".test.ts", ".test.js", ".test.tsx", ".test.jsx", ".spec.ts", ".spec.js", ".spec.tsx", ".spec.jsx",
    "test.java", "tests.java", "test.cs", "tests.cs", "test.kt", "test.zig", "test.php", "_test.rb", "tests.swift",
)


def code(kind: Column, names: tuple[str, ...]) -> Column:
    """1-based place of a name in its closed list; 0 for null or others."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, names)), kind), F.lit(0)).cast("int")


def unsigned_order(col: str) -> list[Column]:
    """Sort keys that order a long by its 64 bits as an unsigned number."""
    return [(F.col(col) < 0).asc(), F.col(col).asc()]


def unsigned(col: Column) -> Column:
    return F.when(col < 0, col.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(col.cast("decimal(20,0)"))


def first_long(seed: Column) -> Column:
    """The first eight bytes of the SHA-256 of a string, little-endian, as the long of the same bits."""
    digest = F.sha2(seed, 256)
    turned = F.concat(*(F.substring(digest, 2 * i + 1, 2) for i in range(7, -1, -1)))
    high, low = F.conv(F.substring(turned, 1, 8), 16, 10).cast("long"), F.conv(F.substring(turned, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def identity_path(path: Column) -> Column:
    """Slashes turned; behind the first ``/repo/`` if there is one."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.regexp_replace(p, "^(?s:.*?)/repo/", "")


def node_id(language: Column, file: Column, kind: Column, qualified_name: Column, container: Column, signature: Column) -> Column:
    none = F.lit("")
    parts = [F.lit("node"), F.coalesce(code(language, LANGUAGES), F.lit(0)).cast("string"), identity_path(file), code(kind, NODE_KINDS).cast("string"), qualified_name, F.coalesce(container, none), F.coalesce(signature, none)]
    return first_long(F.concat_ws("\0", *parts))


def edge_id(src: Column, dst: Column, kind: Column, confidence: Column, label: Column) -> Column:
    parts = [F.lit("edge"), unsigned(src).cast("string"), unsigned(dst).cast("string"), code(kind, EDGE_KINDS).cast("string"), code(confidence, CONFIDENCES).cast("string"), label.isNotNull().cast("string"), F.coalesce(label, F.lit(""))]
    return first_long(F.concat_ws("\0", *parts))


def normalize_signature(s: Column) -> Column:
    """White space beside punctuation dropped, other runs made one blank."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r"\s+", " "), r" ?([(){}\[\],:;<>-]) ?", "$1")


def parameter_count(signature: Column) -> Column:
    """Commas outside inner brackets of the first parenthesis, plus one; 0 if it is blank, null without parentheses."""
    inner = F.regexp_extract(signature, r"\((.*)\)", 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"))
    def step(a, c):
        up, down = c.isin("(", "[", "{", "<"), c.isin(")", "]", "}", ">")
        return F.struct((a["depth"] + F.when(up, 1).when(down, -1).otherwise(0)).alias("depth"), (a["n"] + F.when((c == ",") & (a["depth"] == 0), 1).otherwise(0)).alias("n"))
    counted = F.aggregate(F.split(inner, ""), start, step, lambda a: a["n"])
    return F.when(~F.coalesce(signature.contains("("), F.lit(False)), None).when(F.trim(inner) == "", 0).otherwise(counted + 1)


def extension(path: Column) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    return F.when(base.contains("."), F.lower(F.element_at(F.split(base, r"\."), -1)))


def language_of(path: Column, head: Column | None = None, entrypoints: bool = False) -> Column:
    """Language by extension; a header is C++ if its first 4,096 bytes look like it, unless these are cut amid a letter."""
    found = {e: lang for e, lang in EXTENSIONS.items() if not (entrypoints and e in NOT_FOR_ENTRYPOINTS)}
    pairs = [F.lit(x) for kv in found.items() for x in kv]
    by_name = F.element_at(F.create_map(*pairs), extension(path))
    if head is None:
        return by_name
    text = F.try_validate_utf8(F.substring(head, 1, 4096).cast("string"))
    cpp = F.coalesce(text.rlike("|".join(map(re.escape, CPP_MARKS))), F.lit(False))
    return F.when((extension(path) == "h") & cpp, "cpp").otherwise(by_name)


def excluded(path: Column) -> Column:
    names = F.array(*map(F.lit, EXCLUDED_DIRS))
    return F.exists(F.split(path, "/"), lambda c: F.array_contains(names, c) | c.startswith(".tmp-") | c.endswith(".swp") | c.endswith("~"))


def is_test_file(path: Column) -> Column:
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return p.rlike(r"^tests?/|/tests?/|(" + "|".join(map(re.escape, TEST_SUFFIXES)) + ")$")


def is_test_symbol(name: Column, file: Column) -> Column:
    return is_test_file(file) | F.lower(name).rlike(r"^(test|it_|should_)|_test$")


def looks_like_test(name: Column, file: Column) -> Column:
    """The looser rule of neighbourhoods, context and dead code."""
    return file.contains("test") | name.startswith("test_") | name.endswith("_test")


def is_public(kind: Column, name: Column, file: Column, visibility: Column) -> Column:
    """Part of the public interface; unknown visibility goes by name and file."""
    guess = ~name.startswith("_") & ~file.contains("test") & ~file.contains("internal")
    return ~kind.isin("File", "Module", "Package", "Namespace") & F.when(visibility == "public", True).when(F.coalesce(visibility, F.lit("unknown")) == "unknown", guess).otherwise(False)


def stem(path: Column) -> Column:
    """Lower-cased file name up to the first point, without test marks."""
    base = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.lower(F.regexp_replace(F.regexp_replace(F.element_at(F.split(base, r"\."), 1), "(_test)+$", ""), "^(test_)+", ""))


def normal_path(path: Column) -> Column:
    """``.`` and ``..`` worked off; those that lead above the root vanish."""
    def step(done, part):
        return F.when((part == "") | (part == "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    return F.array_join(F.aggregate(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), F.array().cast("array<string>"), step), "/")


def last_segment(name: Column) -> Column:
    """What stands behind the last ``::``, ``.``, ``->``, ``/`` or ``\\``."""
    return F.regexp_replace(F.rtrim(F.regexp_replace(name, r";\s*$", "")), r"^(?s:.*)(::|->|[./:\\])", "")


def lookup_keys(path: Column) -> Column:
    """Keys by which an import may be found: whole, base name, and both without the extension."""
    p = F.regexp_replace(F.regexp_replace(path, r"^\s*(pub\s+)?(use|import|from|require|include|#include)\s+", ""), r"""['"<>;(){}\s]""", "")
    p = F.regexp_replace(F.regexp_replace(p, r"::|\\", "/"), r"^(\./)+", "")
    known = r"\.(" + "|".join(EXTENSIONS) + ")$"
    whole = F.regexp_replace(p, known, "")
    base = F.element_at(F.split(p, "/"), -1)
    return F.array_distinct(F.filter(F.array(p, base, whole, F.regexp_replace(base, known, "")), lambda x: x != ""))


def layer_regex(pattern: str) -> tuple[str, int] | None:
    """A layer's path pattern as a regular expression over ``/``-joined segments, and its specificity.

    ``*`` pieces are found from the left, unanchored in front: ``model`` matches
    the segment ``mymodel`` too, if its first occurrence ends it; a trailing
    ``**`` stands for any number of segments.
    """
    pattern = pattern.strip("/")
    if not pattern:
        return None

    def segment(p: str) -> str:
        pieces = [x for x in p.split("*") if x]
        if p.startswith("*") or p.endswith("*"):
            return "[^/]*" + "".join(re.escape(x) + "[^/]*" for x in pieces)
        body = "".join(f"(?:(?!{re.escape(x)})[^/])*+{re.escape(x)}" for x in pieces)
        return f"(?:{re.escape(p)}|{body})"

    parts = [s for s in pattern.split("/") if s]
    weight = sum(s != "**" for s in parts)
    if "/" not in pattern:
        return f"(?:^|/){segment(parts[0])}(?:/|$)", weight
    if parts[-1] == "**":
        return "^" + "/".join(map(segment, parts[:-1])) + "(?:/|$)", weight
    return "^" + "/".join(map(segment, parts)) + "$", weight


def escape_dot(s: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def escape_xml(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def escape_mermaid(s: Column) -> Column:
    for a, b in (('"', "#quot;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"), ("]", "&#93;"), ("{", "&#123;"), ("}", "&#125;"), ("(", "&#40;"), (")", "&#41;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def file_name(s: Column) -> Column:
    """A name fit for a file: other characters become ``_``."""
    return F.regexp_replace(s, r"[^A-Za-z0-9._-]", "_")


def percent_decoded(s: Column) -> Column:
    return F.try_url_decode(s)


def query_value(query: Column, key: str) -> Column:
    """Value of a key in a query string, decoded; null without it."""
    return F.try_url_decode(F.element_at(F.str_to_map(query, F.lit("&"), F.lit("=")), key))

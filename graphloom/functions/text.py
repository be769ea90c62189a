"""Scalar functions on paths and source text, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent_module(path: Column) -> Column:
    """Parent directory, ``.`` for a file at the root."""
    d = F.regexp_replace(path, "/?[^/]*$", "")
    return F.when(d == "", ".").otherwise(d)


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def relevance(name: Column, qname: Column, file: Column, term: str) -> Column:
    """100 exact qualified name, 80 exact name, 50 prefix, 30 substring; 15 more for a path hit."""
    t = term.lower()
    n, q = F.lower(name), F.lower(qname)
    base = F.when(q == t, 100).when(n == t, 80).when(n.startswith(t), 50).when(n.contains(t) | q.contains(t), 30).otherwise(0)
    return (base + F.when(F.lower(file).contains(t), 15).otherwise(0)).cast("long")


#: The hexadecimal form of a byte inside a letter: one that does not begin it.
_INNER = "[89AB][0-9A-F]"


def _bytes(data: Column, at: Column, n: Column) -> Column:
    return F.substring(data, at.cast("int") + 1, n.cast("int"))


def begins_letter(data: Column, at: Column) -> Column:
    """Whether a cut at byte ``at`` (from 0) of UTF-8 data lies between letters."""
    return ~F.hex(_bytes(data, at, F.lit(1))).rlike(f"^{_INNER}$")


def byte_cut(text: Column, start: Column, end: Column) -> Column:
    """The letters that lie wholly within the bytes from ``start`` (from 0) to ``end`` (exclusive) of a text.

    A cut inside a letter moves to the next one at the start and back to its
    beginning at the end; places beyond the text count as its ends.  Only the bytes
    next to a cut are looked at.
    """
    data, size = F.encode(text, "UTF-8"), F.octet_length(text)
    start, end = F.least(F.greatest(start, F.lit(0)), size), F.least(F.greatest(end, F.lit(0)), size)
    ahead = F.length(F.regexp_extract(F.hex(_bytes(data, start, F.lit(3))), f"^((?:{_INNER})*)", 1)) / 2
    low = F.greatest(end - 3, F.lit(0))
    back = F.length(F.regexp_extract(F.hex(_bytes(data, low, end - low + 1)), f"^(?:..)*?((?:{_INNER})*)$", 1)) / 2
    first = start + ahead.cast("int")
    last = F.greatest(F.when(end < size, end - back.cast("int")).otherwise(end), first)
    return F.decode(_bytes(data, first, last - first), "UTF-8")


def line_start(text: Column, line: Column) -> Column:
    """Bytes before a line (from 1; less counts as 1), null if the text has fewer lines."""
    before = F.greatest(line - 1, F.lit(0)).cast("int")
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    held = F.octet_length(F.call_function("substring_index", text, F.lit("\n"), before))
    return F.when(before == 0, 0).when(before <= breaks, held + 1)


def span_text(text: Column, start_line: Column, start_col: Column, end_line: Column, end_col: Column) -> Column:
    """The text between two places (lines and byte columns from 1), empty where a place is no line or lies inside a letter.

    An end line beyond the text stands for its end.
    """
    data, size = F.encode(text, "UTF-8"), F.octet_length(text)
    first = line_start(text, start_line) + F.greatest(start_col - 1, F.lit(0))
    last = F.least(F.coalesce(line_start(text, end_line), size) + F.greatest(end_col - 1, F.lit(0)), size)
    first = F.least(first, last)
    whole = line_start(text, start_line).isNotNull() & begins_letter(data, first) & begins_letter(data, last)
    return F.when(whole, F.decode(_bytes(data, first, last - first), "UTF-8")).otherwise("")


def inside_root(path: Column) -> Column:
    """A path without ``.``, ``..`` and empty parts; one that leaves the root, or starts at another, is an error."""
    escape = F.raise_error(F.concat(F.lit("source path escapes the root: "), path)).cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(escape)
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    plain = ~path.rlike(r"(^|/)\.{0,2}(/|$)")
    return F.when(plain, path).otherwise(F.array_join(F.when(path.startswith("/"), escape).otherwise(parts), "/"))

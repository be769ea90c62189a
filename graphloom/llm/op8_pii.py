r"""Personal data: patterns propose, checksums confirm, context adjusts.

Native: only SQL functions on the main path, one map over the texts, no
shuffle.  For each kind a pattern is split out of the text once for the pieces
between the matches and once for the matches; sums of their lengths, taken
in two levels, give spans in code points.  Validators then confirm: parts up to 255 (ip), Luhn
(card), digit counts (card, phone), mod-97 (iban).  Every span gets a score:
what its kind and its checksum are worth, and more if a context word stands in
the 40 characters before it.  Base kinds (email, ip, card, phone) stay whatever
the score; added kinds (iban, ssn) need :data:`LEAST`.

The patterns of the base kinds are written so that they propose the same spans
as the plain ones in time linear in the text:

* a look-behind keeps a match from being tried again inside a run of digits or
  address characters, where it would fail for the same reason;
* possessive repeats do not give back what cannot start the next item;
* the number of digits of a card is bounded inside the pattern, with the
  look-arounds that make the run maximal, so ordinary numbers give no match.

Null and empty texts have no spans.  Rows are kept one to one, repeated ones and
null ids included; very long texts are searched whole, in time linear in the
text but for n * sqrt(n) sums over n matches.  Columns other than id and text
are left out.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CONTEXT = 40
#: Earlier matches in which the context may lie: none is shorter than 5 characters.
BACK = 8
LEAST = 0.6

#: kind: (cheap condition, pattern, validator of the matched string x, worth, worth of context, context words)
KINDS = {
    "email": ("contains(t, '@')", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", 0.8, 0.2, "mail|contact|write|courriel|correo"),
    "ip": ("t rlike '[0-9]\\\\.[0-9]'", r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", r"x rlike '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.]0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$'", 0.7, 0.2, "ip|host|server|address|adresse"),
    "card": ("t rlike '[0-9]'", r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])", "{luhn}", 0.9, 0.1, "card|visa|credit|debit|carte|tarjeta|karte"),
    "phone": ("contains(t, '+')", r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(x, '[^0-9]', '')) between 8 and 15", 0.7, 0.2, "phone|call|tel|mobile|fax"),
    "iban": ("t rlike '[A-Z]{2}[0-9]{2}[ A-Z0-9]'", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)", "{mod97}", 0.8, 0.2, "iban|account|bank|konto|compte|cuenta"),
    "ssn": ("t rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "true", 0.4, 0.3, "ssn|social|security"),
}
BASE = ("email", "ip", "card", "phone")

LUHN = (
    "aggregate(split(reverse(regexp_replace(x, '[^0-9]', '')), ''), named_struct('k', 0, 's', 0), (a, c) -> named_struct('k', a.k + 1, 's', a.s + "
    "case when a.k % 2 = 0 then int(c) when int(c) > 4 then 2 * int(c) - 9 else 2 * int(c) end), a -> a.s % 10 = 0)"
)
MOD97 = (
    "aggregate(split(concat(substr(replace(x, ' ', ''), 5), substr(x, 1, 4)), ''), 0, (a, c) -> "
    "case when c between '0' and '9' then (a * 10 + int(c)) % 97 else (a * 100 + ascii(c) - 55) % 97 end, a -> a = 1)"
)
_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """(id_col, <kind> ... ): for each kind its spans (kind, start, end, score) in order."""
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    for kind in kinds:
        cheap, pattern, check, worth, more, words = KINDS[kind]
        lit = "'" + pattern.replace("\\", "\\\\") + "'"
        check = check.replace("{luhn}", LUHN).replace("{mod97}", MOD97)
        df = df.withColumn("m", F.expr(f"case when {cheap} then regexp_extract_all(t, {lit}, 0) else cast(array() as array<string>) end"))
        df = df.withColumn("q", F.expr(f"case when size(m) > 0 then split(t, {lit}, -1) else cast(array() as array<string>) end"))
        df = df.withColumn("p", F.expr("transform(q, s -> length(s))"))
        df = df.withColumn("q", F.expr(f"transform(q, s -> right(s, {CONTEXT}))"))
        # each match with the end of what stands before it; the context lies in the last BACK of these
        df = df.withColumn("e", F.expr("transform(m, (x, i) -> concat(q[i], x))"))
        # starts of the matches as sums in two levels: over whole blocks of about sqrt(n) lengths, then within the block
        df = df.withColumn("n", F.expr("transform(m, (x, i) -> p[i] + length(x))"))
        df = df.withColumn("w", F.expr("cast(ceil(sqrt(size(n))) as int)"))
        df = df.withColumn("b", F.expr("case when w = 0 then cast(array() as array<int>) else transform(sequence(0, w - 1), j -> aggregate(slice(n, j * w + 1, w), 0, (a, x) -> a + x)) end"))
        df = df.withColumn("c", F.expr("transform(b, (x, j) -> aggregate(slice(b, 1, j), 0, (a, y) -> a + y))"))
        df = df.withColumn("s", F.expr(f"transform(m, (x, i) -> named_struct('start', c[i div w] + aggregate(slice(n, cast(i div w as int) * w + 1, i % w), 0, (a, y) -> a + y) + p[i], 'x', x, 'before', right(concat(array_join(slice(e, greatest(i - {BACK}, 0) + 1, least(i, {BACK})), ''), q[i]), {CONTEXT})))"))
        df = df.withColumn("s", F.expr("transform(s, r -> named_struct('start', r.start, 'end', r.start + length(r.x), 'x', r.x, 'before', r.before))"))
        df = df.withColumn("s", F.expr(f"filter(s, r -> exists(array(r.x), x -> {check}))"))
        score = f"{worth}D + case when lower(r.before) rlike '{words}' then {more}D else 0D end"
        df = df.withColumn(kind, F.expr(f"cast(transform(s, r -> named_struct('kind', '{kind}', 'start', r.start, 'end', r.end, 'score', {score})) as {_SPAN})"))
        if kind not in BASE:
            df = df.withColumn(kind, F.expr(f"filter({kind}, r -> r.score >= {LEAST}D)"))
    return df.drop("m", "q", "e", "p", "n", "w", "b", "c", "s", "t")


def _joined(*kinds: str) -> str:
    return f"array_join(transform(concat({', '.join(kinds)}), r -> concat(r.kind, ':', r.start, ':', r.end)), ',')"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(common.read_table(spark, sf_dir, "documents", "doc_id", "text"))
    counts = [F.expr(f"cast(size({k}) as bigint)").alias(f"n_{k}") for k in KINDS]
    scores = f"array_join(transform(concat({', '.join(KINDS)}), r -> cast(round(r.score * 100) as int)), ',')"
    return found.select("doc_id", *counts, F.expr(f"sha2({_joined(*BASE)}, 256)").alias("base_sha256"), F.expr(_joined(*KINDS)).alias("spans"), F.expr(scores).alias("scores"))


def _oracle() -> str:
    """The contract's plain patterns; RE2 needs no look-arounds to be linear."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": KINDS["iban"][1],
        "ssn": KINDS["ssn"][1],
    }
    digits = "regexp_replace(x, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, len({digits}) + 1), lambda i: case when i % 2 = 1 then {digits}[-i]::int when {digits}[-i]::int > 4 then 2 * {digits}[-i]::int - 9 else 2 * {digits}[-i]::int end)) % 10 = 0"
    turned = "(substr(replace(x, ' ', ''), 5) || x[1:4])"
    number = f"list_reduce(list_transform(string_split({turned}, ''), lambda c: case when c between '0' and '9' then c else (ascii(c) - 55)::varchar end), lambda a, c: a || c)"
    check = {
        "email": "true",
        "ip": "len(list_filter(string_split(x, '.'), lambda q: q::hugeint > 255)) = 0",
        "card": f"len({digits}) between 16 and 19 and {luhn}",
        "phone": f"len({digits}) between 8 and 15",
        "iban": f"list_reduce(list_transform(string_split({number}, ''), lambda c: c::bigint), lambda a, c: (a * 10 + c) % 97) = 1",
        "ssn": "regexp_matches(before, 'ssn|social|security')",
    }
    parts = []
    for i, (kind, pattern) in enumerate(plain.items()):
        parts.append(
            f"select doc_id, {i} as o, '{kind}' as kind, st, st + length(x) as en, {round(100 * KINDS[kind][3])} + case when regexp_matches(before, '{KINDS[kind][5]}') then {round(100 * KINDS[kind][4])} else 0 end as sc from ("
            f"select doc_id, x, lower(substr(t, (greatest(st - {CONTEXT}, 0) + 1)::bigint, least({CONTEXT}, st)::bigint)) as before, st from ("
            f"select doc_id, t, m[i] as x, (list_sum(list_transform(p[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0))::bigint as st from ("
            f"select *, unnest(range(1, len(m) + 1)) as i from (select doc_id, t, regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as p from docs)))) "
            f"where {check[kind]}"
        )
    counts = ", ".join(f"count(s.kind) filter (s.kind = '{k}') as n_{k}" for k in plain)
    one = "s.kind || ':' || s.st || ':' || s.en"
    return (
        "with docs as (select doc_id, coalesce(text, '') as t from documents), spans as (" + " union all ".join(parts) + ") "
        f"select d.doc_id, {counts}, sha256(coalesce(string_agg({one}, ',' order by s.o, s.st) filter (s.o < 4), '')) as base_sha256, "
        f"coalesce(string_agg({one}, ',' order by s.o, s.st), '') as spans, coalesce(string_agg(s.sc::varchar, ',' order by s.o, s.st), '') as scores from docs d left join spans s on d.doc_id = s.doc_id group by d.doc_id"
    )


ORACLE = _oracle()

"""Personal data against the query's SQL and against plain patterns; nulls, long texts, repeated rows, empty tables."""

import hashlib
import re
import time

import duckdb
import pandas as pd

from graphloom.llm import op8_pii

ROWS = [
    (1, "mail me: joe.doe+x@mail.example.com, or a@b.c. bad@x"),
    (2, None),
    (3, ""),
    (4, "host 10.0.0.1 and 300.1.1.1, 1.2.3.4.5.6.7.8 v1.2.3"),
    (5, "card 4111 1111 1111 1111, 4111-1111-1111-1112, 41111111111111111111111111"),
    (6, "call +49 (30) 123-4567 or +1 2, é +33 1 23 45 67 89."),
    (7, "IBAN DE89370400440532013000 and DE00370400440532013000; ssn 123-45-6789, 123-45-6789"),
    (1, "mail me: joe.doe+x@mail.example.com, or a@b.c. bad@x"),
    (None, "x@y.zz"),
    (8, "日本 a@b.cc é x@y.org"),
]


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text: str) -> str:
    plain = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda x: True),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", lambda x: 16 <= len(re.sub("[^0-9]", "", x)) <= 19 and luhn(re.sub("[^0-9]", "", x))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(re.sub("[^0-9]", "", x)) <= 15),
    }
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in plain.items() for m in re.finditer(p, text) if ok(m[0]))


def test_spans(spark, tmp_path):
    pd.DataFrame(ROWS, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    got = [r.asDict() for r in op8_pii.op8_pii(spark, str(tmp_path)).collect()]
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        mine = [r for r in got if r["doc_id"] == i]
        assert mine and all(r["base_sha256"] == hashlib.sha256(base(t or "").encode()).hexdigest() for r in mine), (i, t)
    seven = next(r for r in got if r["doc_id"] == 7)
    assert (seven["n_iban"], seven["n_ssn"]) == (1, 2) and len(seven["scores"].split(",")) == 3


def test_sql(spark, tmp_path):
    """The query's SQL; it groups by id, so ids are single here."""
    rows = [(i, t) for i, t in enumerate(t for _, t in ROWS)]
    pd.DataFrame(rows, columns=["doc_id", "text"]).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(op8_pii.ORACLE).df()
    got = op8_pii.op8_pii(spark, str(tmp_path)).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    key = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy().tolist()))
    assert key(got) == key(want)


def test_many_matches(spark):
    """Thousands of matches in a text, not far from linear time; clashing column names; an empty table."""
    text = " ".join(f"user{i}@mail{i % 7}.example.com" for i in range(16_000))
    df = spark.createDataFrame([(1, text, "x", 5)], "doc_id long, text string, spans string, m int")
    start = time.time()
    out = op8_pii.find_spans(df).collect()
    assert len(out[0]["email"]) == 16_000 and time.time() - start < 30
    assert [(s["start"], s["end"]) for s in out[0]["email"]] == [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    assert op8_pii.find_spans(df.limit(0)).count() == 0

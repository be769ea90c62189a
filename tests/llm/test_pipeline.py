"""The pipeline's stages on planted cases, against plain Python."""

import random

import pandas as pd
import pytest

import corpus_pipeline
from graphloom.llm import op10_token_counts

RNG = random.Random(21)
VOCAB = [f"w{i}x" for i in range(500)]


def text(n: int) -> str:
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    passage, item, near = text(60), text(25), text(90)
    docs = {i: "\n".join(text(40) for _ in range(3)) for i in range(1, 21)}
    docs[30] = docs[1]  # an exact copy: all its lines match earlier ones
    docs[31], docs[32] = f"{text(30)}\n{passage}", f"{text(30)}\n{passage}"
    docs[33], docs[34] = near, near.replace(near.split()[44], "changed", 1)
    docs[35] = f"{text(30)} {item} {text(30)}"
    docs[36] = "idiot scum moron trash loser pathetic " + text(10)
    docs[37], docs[38] = None, ""
    rows = [(i, t, "en", "src", len(t or "")) for i, t in docs.items()] + [(None, text(12), "en", "src", 1), (5, docs[5], "en", "src", len(docs[5]))]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"}).to_parquet(d / "documents.parquet")
    pd.DataFrame({"doc_id": pd.Series([], dtype="int64"), "quality": pd.Series([], dtype="int32"), "toxic": pd.Series([], dtype="int32")}).to_parquet(d / "labels.parquet")
    pd.DataFrame({"item_id": [1], "text": [item]}).to_parquet(d / "benchmark.parquet")
    return str(d), docs, passage


def test_stages(spark, sf_dir):
    path, docs, passage = sf_dir
    frame = spark.read.parquet(f"{path}/documents.parquet")
    columns = frame.columns
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, path)
        frame.write.mode("overwrite").parquet(f"{path}/out-{name}")
        frame = spark.read.parquet(f"{path}/out-{name}")
        after[name] = frame.collect()
        if name != "packing":
            assert frame.columns == columns
    ids = lambda name: [r["doc_id"] for r in after[name]]
    assert set(docs) - set(ids("toxicity")) == {36}
    lines = {r["doc_id"]: r["text"] for r in after["line_dedup"]}
    assert len(after["line_dedup"]) == len(after["toxicity"])
    assert lines[30] == "" and passage in lines[31] and passage not in lines[32] and lines[34] == ""  # the near copy is one line
    assert all(lines[i] == docs[i] for i in range(1, 21)) and lines[37] is None
    assert sorted(x for x in ids("ngram_join") if x is not None) == sorted(set(ids("line_dedup")) - {None}) and ids("ngram_join").count(5) == 1
    assert set(ids("ngram_join")) - set(ids("decontamination")) == {35}
    packed = {}
    for r in after["packing"]:
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    want = {r["doc_id"]: r["n_tokens"] + 1 for r in op10_token_counts.token_counts(spark.read.parquet(f"{path}/out-decontamination")).collect()}
    assert packed == want


def test_one_of_each_group_stays(spark):
    base = text(120)
    rows = [(1, base), (2, base), (3, base.replace(base.split()[60], "z", 1)), (4, text(80)), (4, text(80)), (None, base), (5, ""), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in corpus_pipeline.ngram_join(spark, df, "").collect()), key=repr)
    assert got == sorted([rows[0], rows[3], rows[4], rows[5], rows[6], rows[7]], key=repr)


def test_empty_corpus(spark, sf_dir, tmp_path):
    path, _, _ = sf_dir
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0

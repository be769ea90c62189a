"""Token ids, counts, blocks and packing against the tokenizers library, round trips and plain solvers."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from graphloom.llm import bpe, op1_pfor, op6_packing, op10_token_counts

RNG = random.Random(9)
PIECES = ["a", "b", "é", " ", "\n", "  ", "1", "<", "|", ".", "'s", "Z", "日", "\t", "the", "<|endoftext|>", "\r", "ß"]
TEXTS = ["", None, " ", "\n", "a", " a", "a ", "a\nb", "a\n\nb", "<|endoftext|> x", "don't 45,6 $$$", "x" * 3000, "日本 語", "\x7f", "word " * 5000]
TEXTS += ["".join(RNG.choice(PIECES) for _ in range(RNG.randrange(14))) for _ in range(400)]
#: id, text and a column whose name clashes with the result; a repeated row, a repeated and a null id.
ROWS = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "x"), (7, "other", "x"), (None, "none", "x")]


def library(name: str, texts) -> list[list[int]]:
    tok = Tokenizer.from_file(bpe.tokenizer_path(name))
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens string")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_as_the_library(name):
    coder = bpe.BatchCoder(bpe.tokenizer_path(name))
    for _ in range(2):  # the second time from the table
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(pa.array(TEXTS))] == library(name, TEXTS)


def test_small_table(monkeypatch):
    """Words that take one another's slots."""
    monkeypatch.setattr(bpe, "TABLE", 8)
    name = "byte_bpe_50k.json"
    coder, counter = bpe.BatchCoder(bpe.tokenizer_path(name)), bpe.BatchCounter(bpe.tokenizer_path(name))
    texts = [" ".join(RNG.choice(["alpha", "beta", "gammadelta" * 3, "x1", "ééé"]) + str(RNG.randrange(30)) for _ in range(20)) for _ in range(50)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(pa.array(texts))] == library(name, texts)
        assert counter.count(pa.array(texts)).tolist() == [len(x) for x in library(name, texts)]


def test_counts(spark, docs):
    got = sorted((tuple(r) for r in op10_token_counts.token_counts(docs).collect()), key=repr)
    ids = library("byte_bpe_50k.json", [t for _, t, _ in ROWS])
    assert got == sorted(((i, len((t or "").encode()), len(x), len(x) > 512) for (i, t, _), x in zip(ROWS, ids, strict=True)), key=repr)
    assert op10_token_counts.token_counts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("values", [[], [7], [3] * 2500, [0, 2**32 - 1] * 700, list(range(5000)), [5] * 1023 + [2**31], [2**32 - 1] * 3])
def test_block_round_trip(values):
    ids = np.array(values, np.uint32)
    blocks = op1_pfor.encode_blocks(ids)
    assert len(blocks) == -(-len(ids) // op1_pfor.BLOCK)
    assert op1_pfor.decode_blocks(blocks).tolist() == values


def test_random_access():
    sink, rng = io.BytesIO(), np.random.default_rng(1)
    writer = op1_pfor.PforWriter(sink)
    every = [rng.integers(0, 2 ** rng.integers(1, 32), rng.integers(0, 3000)).astype("<u4") for _ in range(40)]
    for i, ids in enumerate(every):
        writer.add(i, ids.tobytes())
    writer.close()
    reader = op1_pfor.PforReader(sink, len(sink.getvalue()))
    flat = np.concatenate(every)
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(flat) + 1, 2).tolist())
        assert reader.ids(a, b).tolist() == flat[a:b].tolist()
    assert [(d, n, c) for d, n, c in reader.documents()] == [(i, len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(every)]


def test_written_files(spark, docs, tmp_path):
    path = f"file://{tmp_path}/ids"
    got = [tuple(r) for r in op1_pfor.read_pfor(spark, path, op1_pfor.write_pfor(docs, path)).orderBy("start").collect()]
    ids = [np.array([*x, 2], "<u4").tobytes() for x in library("word_bpe_49k.json", [t for _, t, _ in ROWS])]
    want = sorted((-1 if i is None else i, len(x) // 4, zlib.crc32(x)) for (i, _, _), x in zip(ROWS, ids, strict=True))
    assert sorted((-1 if r[0] is None else r[0], r[2], r[3]) for r in got) == want
    assert [-1 if r[0] is None else r[0] for r in got] == [w[0] for w in want]
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    assert op1_pfor.write_pfor(docs.limit(0), f"{path}-none").count() == 0


def test_packing(spark, docs):
    pieces = op6_packing.pack(docs).collect()
    ids = [np.array([*x, 0], "<u4") for x in library("byte_bpe_50k.json", [t for _, t, _ in ROWS])]
    whole = sorted((-1 if i is None else i, len(x)) for (i, _, _), x in zip(ROWS, ids, strict=True))
    firsts = sorted((-1 if p["doc_id"] is None else p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0)
    assert firsts == whole
    sums = {(i, len(x), s): zlib.crc32(x[s : s + 1024].tobytes()) for (i, _, _), x in zip(ROWS, ids, strict=True) for s in range(0, len(x), 1024) if i not in (5, 7)}
    assert all(p["ids_crc32"] == sums[p["doc_id"], p["doc_tokens"], p["start"]] for p in pieces if p["doc_id"] not in (5, 7))
    by_sequence: dict[int, list] = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(len(x) for x in ids)
    assert len(by_sequence) <= total // 1024 + 2
    assert op6_packing.pack(docs.limit(0)).count() == 0


def test_least_squares():
    """The solver's residual is no larger than that of plain coordinate descent."""
    rng = np.random.default_rng(4)
    window = 24
    combos = op6_packing.combinations(window)
    hist = np.r_[0, rng.integers(0, 50, window - 1)].astype(float)
    a = np.zeros((window, len(combos)))
    for j, c in enumerate(combos):
        for n in c:
            if n:
                a[n, j] += 1
    x = np.zeros(len(combos))
    for _ in range(2000):
        for j in range(len(combos)):
            x[j] = max(0.0, x[j] + a[:, j] @ (hist - a @ x) / (a[:, j] @ a[:, j]))
    got = op6_packing.solve_repeats(hist, combos, 2000)
    assert (got >= 0).all()
    assert np.linalg.norm(a @ got - hist) <= np.linalg.norm(a @ x - hist) * 1.01 + 1e-6

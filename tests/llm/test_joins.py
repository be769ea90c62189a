"""Joins and searches against brute force; nulls, empty texts, ties, repeated rows, empty tables."""

import random

import numpy as np
import pytest

from graphloom.llm import common, op2_toxicity, op3_line_dedup, op4_decontam, op5_ngram_join, op9_near_vectors, setjoin, words

RNG = random.Random(5)
VOCAB = [f"w{i}" for i in range(390)] + [f"É{i}ñ" for i in range(10)]


def text(n: int) -> str:
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def edited(t: str, k: int) -> str:
    w = t.split()
    for _ in range(k):
        w[RNG.randrange(len(w))] = RNG.choice(VOCAB)
    return " ".join(w)


def corpus() -> list[tuple]:
    rows = [text(RNG.randrange(1, 120)) for _ in range(60)]
    base = [text(100), text(60), text(5)]
    rows += [edited(b, k) for b in base for k in (0, 0, 1, 1, 2, 3, 4)]
    chain = text(150)
    for _ in range(12):
        chain = edited(chain, 2)
        rows.append(chain)
    rows += ["", "   \n", "One", "one", base[0].upper(), None, None]
    RNG.shuffle(rows)
    return list(enumerate(rows)) + [(3, rows[3]), (None, rows[5])]


def many_copies() -> list[str]:
    """A group of near copies, larger than small slices, and passages that many texts share."""
    base, passage = text(120), text(60)
    return [edited(base, 2) for _ in range(40)] + [f"{text(12)} {passage}" for _ in range(25)] + [f"{text(60)} {passage}" for _ in range(10)]


def union_find(n, pairs):
    p = list(range(n))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        p[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def similar(a: set, b: set) -> bool:
    return bool(a) and 100 * len(a & b) >= 80 * len(a | b)


def shingles(t):
    w = (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def shingle_input(t):
    import pyarrow as pa

    data, at = words.raw(pa.array([t]))
    h, start, _ = words.words(data, at)
    return h, words.owners(at, start), 1


@pytest.mark.parametrize(("size", "rounds", "hot"), [(2000, 2, False), (3, 2, True), (4, 0, False), (2, 1, True)])
def test_ngram_components(spark, monkeypatch, size, rounds, hot):
    monkeypatch.setattr(setjoin, "SLICE", size)  # small ones make several slices of a list
    rows = corpus()
    rows += [(1000 + i, t) for i, t in enumerate(many_copies())]
    if hot:  # half of all tokens as hot ones, so that tokens come by both ways
        tokens = np.concatenate([words.sets_of(*shingle_input(t), 5)[0] for _, t in rows if t])
        monkeypatch.setattr(setjoin, "hot_tokens", lambda reported: np.unique(tokens[tokens % np.uint64(2) == 0]))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = op5_ngram_join.ngram_components(docs, rounds=rounds).collect()
    n = max(i for i, _ in rows if i is not None) + 1
    sets = [set()] * n
    for i, t in rows:
        if i is not None:
            sets[i] = shingles(t)
    comp = union_find(n, [(a, b) for a in range(n) for b in range(a) if similar(sets[a], sets[b])])
    assert sorted((r[0], r[1], r[2]) for r in got if r[0] is not None) == sorted((i, len(sets[i]), comp[i]) for i, _ in rows if i is not None)
    assert len(got) == len(rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op5_ngram_join.ngram_components(docs).count() == 0
    assert op3_line_dedup.dedup_lines(docs).count() == 0
    assert op4_decontam.contamination(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert op9_near_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize(("size", "rounds"), [(2000, 2), (3, 1), (2, 0)])
def test_line_dedup(spark, monkeypatch, size, rounds):
    monkeypatch.setattr(setjoin, "SLICE", size)
    lines = [t for _, t in corpus() if t] + many_copies()
    docs, at = [], 0
    while at < len(lines):
        k = RNG.randrange(1, 6)
        docs.append((len(docs), "\n".join(lines[at : at + k]), 7))
        at += k
    docs += [(900, None, 1), (None, docs[0][1], 2), docs[2], (901, "", 3)]
    order = sorted({(i, no, line) for i, t, _ in docs if i is not None and t for no, line in enumerate(t.split("\n"))})
    gone, before = set(), []
    for i, no, line in order:
        s = shingles(line)
        if any(similar(s, o) for o in before):
            gone.add((i, no))
        before.append(s)
    want = sorted(((i, t if i is None or t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone), k) for i, t, k in docs), key=repr)
    df = spark.createDataFrame(docs, "doc_id long, text string, lines int")
    assert sorted((tuple(r) for r in op3_line_dedup.dedup_lines(df, rounds=rounds).collect()), key=repr) == want
    assert gone


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_scores():
    for _ in range(150):
        a, b = [RNG.choice("abcd") for _ in range(RNG.randrange(1, 15))], [RNG.choice("abcde") for _ in range(RNG.randrange(1, 25))]
        assert op4_decontam.align(a, b)[0] == plain_alignment(a, b)


def test_decontamination(spark):
    items = [(i, text(30)) for i in range(8)] + [(8, None), (9, "")]
    docs = [(i, text(200)) for i in range(40)]
    docs += [(100 + i, f"{text(50)} {edited(items[i][1], 3)} {text(40)}") for i in range(8)] + [(200, None), (201, ""), (None, items[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in op4_decontam.contamination(df, bench).collect()}
    assert got == {(100 + i, i) for i in range(8)} | {(None, 0)}
    assert {r["doc_id"] for r in op4_decontam.decontaminate(df, bench).collect()} == set(range(40)) | {200, 201}


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    vecs = [(base[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.6])).tolist() for i in range(300)]
    rows = [(i, v, i % 3) for i, v in enumerate(vecs)]
    rows += [(400, vecs[5], 5 % 3), (401, None, 1), (402, [0.0] * 16, 1), (403, [float("nan")] * 16, 1), (404, vecs[0], None), (405, [1.0, None], 1), (None, vecs[1], 1), rows[7]]
    got = op9_near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    x = [op9_near_vectors.unit(v) if y is not None else None for _, v, y in rows]
    exact = {}
    for i, (a, _, y) in enumerate(rows):
        if a is not None:
            exact[a] = len({b for j, (b, _, z) in enumerate(rows) if b not in (None, a) and y == z and x[i] is not None and x[j] is not None and float(x[i] @ x[j]) >= 0.98})
    links = {r["vec_id"]: r["n_links"] for r in got.collect() if r["vec_id"] is not None}
    assert set(links) == set(exact) and all(links[k] <= exact[k] for k in exact)
    assert op9_near_vectors.recall(got, spark.createDataFrame(list(exact.items()), "vec_id long, n_links long")) >= 0.9
    assert got.count() == len(rows)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = op2_toxicity.op2_toxicity(spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = out[out.held_out]
    hit = held[held.toxic == 1].score.to_numpy()
    rest = held[held.toxic == 0].score.to_numpy()
    assert (hit[:, None] > rest[None]).mean() > 0.85
    assert (rest >= 0.7).mean() < 0.05
    assert 0 <= op2_toxicity.lexicon_model().scorer()(None) <= 0.1


def test_components_by_both_ways(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(None, 3), (7, 7)]
    df = spark.createDataFrame(pairs, "a long, b long")
    low = union_find(500, [(a, b) for a, b in pairs if a is not None])
    want = {x: low[x] for a, b in pairs if a is not None and a != b for x in (a, b)}
    for bound in (None, 0):
        assert {r[0]: r[1] for r in common.components(df, task_edges=bound).collect()} == want

"""Near vectors against brute force where a group of near copies spans many shards."""

import numpy as np
import pytest

from graphloom.llm import op9_near_vectors


def exact_links(rows):
    """Links by the full matrix of cosines, per label."""
    out = {}
    for y in {y for _, _, y in rows}:
        ids = np.array([i for i, _, z in rows if z == y])
        x = np.array([v for _, v, z in rows if z == y])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= op9_near_vectors.COSINE
        for at, i in enumerate(ids):
            out[int(i)] = [int(near[at].sum()) - 1, None]
        todo = set(range(len(ids)))
        while todo:
            front, comp = {min(todo)}, set()
            while front:
                comp |= front
                front = set(np.nonzero(near[list(front)].any(0))[0].tolist()) - comp
            for at in comp:
                out[int(ids[at])][1] = int(ids[list(comp)].min())
            todo -= comp
    return {i: tuple(v) for i, v in out.items()}


@pytest.mark.parametrize("per_centre", [60, 8])  # the small one makes slices of shards too
def test_large_group_of_near_copies(spark, monkeypatch, per_centre):
    monkeypatch.setattr(op9_near_vectors, "PER_CENTRE", per_centre)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=64)
    group = middle + rng.normal(size=(700, 64)) * 0.12  # pairs at cosine about 0.986
    rest = rng.normal(size=(300, 64))
    rest[150:] = rest[:150] + rng.normal(size=(150, 64)) * rng.choice([0.1, 0.3], size=(150, 1))
    vecs = np.concatenate([group, rest])
    rows = [(i, vecs[i].tolist(), int(i % 10 == 0)) for i in rng.permutation(len(vecs)).tolist()]
    got = op9_near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = exact_links(rows)
    assert sum(n for n, _ in want.values()) > 100_000
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want


def test_recall_of_ten_thousand_near_copies(spark):
    """The audit, for all rows, with the centres that the query uses."""
    rng = np.random.default_rng(11)
    vecs = np.concatenate([rng.normal(size=64) + rng.normal(size=(10_000, 64)) * 0.1, rng.normal(size=(500, 64))])
    x = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    exact = [int((x[i] @ x.T >= op9_near_vectors.COSINE).sum()) - 1 for i in range(len(x))]
    assert sum(exact) > 90_000_000
    found = op9_near_vectors.near_vectors(spark.createDataFrame([(i, v, 0) for i, v in enumerate(vecs.tolist())], "vec_id long, embedding array<double>, label int"))
    assert op9_near_vectors.recall(found, spark.createDataFrame(list(enumerate(exact)), "vec_id long, n_links long")) == 1.0


def test_one_id_for_several_vectors_and_labels(spark):
    """Rows are told apart by id, label and vector; the brute force compares rows, repeated ones once."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 16))
    rows = []
    for _ in range(300):
        v = base[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.12])
        rows.append((int(rng.integers(60)), v.tolist(), int(rng.integers(3))))
    rows += rows[:40] + [(7, None, 1), (7, [0.0] * 16, 1), (7, base[0].tolist(), None)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in op9_near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    known = sorted({(i, y, tuple(v)) for i, v, y in rows if v and any(v) and y is not None})
    x = np.array([k[2] for k in known])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([k[1] for k in known])
    near = (x @ x.T >= op9_near_vectors.COSINE) & (label[:, None] == label)
    reach = near.copy()
    while (more := reach @ near).sum() > reach.sum():
        reach = more
    ids = np.array([k[0] for k in known])
    of = {k: (k[0], int(near[n].sum()) - 1, int(ids[reach[n]].min())) for n, k in enumerate(known)}
    want = [(*of[i, y, tuple(v)], of[i, y, tuple(v)][2] == i) if v and any(v) and y is not None else (i, 0, i, True) for i, v, y in rows]
    assert got == sorted(want) and any(w[1] for w in want)

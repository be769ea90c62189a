"""The label model on planted noise and copied voters; edge cases of fitting and scoring."""

import numpy as np

from graphloom.llm import op2_toxicity as tox


def planted(n=3000, voters=14, seed=3):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.15).astype(int)
    up, down = rng.uniform(0.35, 0.8, voters), rng.uniform(0.0, 0.03, voters)
    return y, rng.random((n, voters)) < np.where(y[:, None] == 1, up, down)


def test_noise_in_given_labels_is_overruled():
    y, votes = planted()
    rng = np.random.default_rng(5)
    flip = rng.random(len(y)) < 0.08
    given = np.where(flip, 1 - y, y)
    post, _, right = tox.label_model(votes, given)
    assert flip.sum() > 200
    assert ((post > 0.5) != (y == 1)).sum() < flip.sum() / 4
    assert abs(right - 0.92).max() < 0.05


def test_clean_labels_are_believed():
    y, votes = planted()
    post, _, right = tox.label_model(votes, y)
    assert ((post > 0.5) != (y == 1)).mean() < 0.01 and right.min() > 0.9


def test_copied_voters_share_a_vote():
    y, votes = planted(voters=6)
    copied = np.concatenate([votes, np.repeat(votes[:, :1], 4, axis=1)], axis=1)
    _, share, _ = tox.label_model(copied, y)
    assert np.allclose(share[[0, 6, 7, 8, 9]], 0.2, atol=0.05) and share[1:6].min() > 0.5


def test_edges(spark):
    docs = [(1, "you idiot moron", 9.0), (2, None, 1.0), (3, "", 1.0), (None, "a plain text", 1.0), (1, "you idiot moron", 9.0), (4, "word " * 50_000 + "idiot scum trash moron loser", 2.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = sorted((tuple(r) for r in tox.score_toxicity(df, tox.fit(tox.training_rows(df, none))).collect()), key=repr)
    assert len(got) == 6 and {(r[0], r[3]) for r in got} == {(1, 1), (2, 0), (3, 0), (None, 0), (4, 1)}
    assert all(0 <= r[2] <= 1 for r in got)
    assert tox.score_toxicity(df.limit(0), tox.lexicon_model()).count() == 0


def test_held_out_labels_are_not_read(spark):
    """Labels of rows with crc32 mod 3 = 1 change nothing."""
    import zlib

    docs = spark.createDataFrame([(i, f"word{i % 7} text {'scum' if i % 4 == 0 else 'fine'}") for i in range(120)], "doc_id long, text string")
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = lambda flip: spark.createDataFrame([(i, int(i % 4 == 0) if i not in held else flip) for i in range(120)], "doc_id long, toxic int")
    a, b = tox.training_rows(docs, rows(0)), tox.training_rows(docs, rows(1))
    assert len(a.y) == 120 - len(held) and (a.y == b.y).all() and (a.votes == b.votes).all()


def plain_score(model, text):
    """The score by its definition: every voter that fires, every part of every word."""
    bag = tox.words(text)
    total, k, w = sum(bag.values()), len(model.voters), model.weights
    z = w[-1] + sum(w[model.voters[v]] for v in tox.fired_by(tox.part_counts(bag), total) if v in model.voters)
    return tox.sigmoid(z + sum(w[k + s] * n**0.5 for word, n in bag.items() for s in tox.slots(word)) / max(total, 1) ** 0.5)


def test_scores_are_those_of_the_definition(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r["text"] for r in rows] + [None, "", "Ünïcode ÜNÏCODE " * 40, "x" * 100_000, "ab abcd abcde abcdefgh " * 9, "😀 scum"]
    names = [n for t in texts[:40] for p in tox.part_counts(tox.words(t)) for n in (p, f"{p}#2", f"{p}#8", f"{p}%1")][::5]
    voters = {v: i for i, v in enumerate(dict.fromkeys(map(tox.key, [*tox.LEXICON, *names])))}
    model = tox.Model(voters, np.random.default_rng(1).normal(0, 0.3, len(voters) + tox.HASHED + 1))
    score = model.scorer()
    want, got = np.array([plain_score(model, t) for t in texts]), np.array([score(t) for t in texts])
    assert len(voters) > 500 and np.abs(want - got).max() < 1e-9
    small = model.scorer()
    assert [small(t) for t in reversed(texts)] == list(got[::-1])  # the order of texts changes nothing

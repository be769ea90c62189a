"""Toxicity by weak supervision.

Voters are a fixed lexicon and patterns (words and word beginnings, each at some
least number of occurrences or share of a text's words).  Patterns are proposed
by how they stand out among the labelled training rows, as a developer of
labelling functions would; what they are worth is not read off the labels but
estimated.  A generative model with a hidden label per row is fitted by
expectation maximisation: every voter has a rate of firing
under either hidden label, and in every round voters that fire together more
than the hidden label explains share one vote in proportion to that correlation.
The given label is one more voter, with the two accuracies that its agreement
with the other voters (not with a posterior that it took part in) shows.  The posterior may thus overrule a given label.  A linear
classifier over the voters and hashed words is trained on the posterior labels.

Executors count patterns and make features of the whole texts of at most
``max_labelled`` labelled rows (those with the smallest hash of their id); the
driver gets numbers only, some 10 KB a row, and fits.  Scoring reads whole texts
of every row, without a shuffle.  Labels come only from rows whose crc32 of the
id as text, mod 3, is not 1.  Language, source and id are never inputs of a score.

Null and empty texts get the score of a text without words; very long texts are
read whole.  Null ids are scored like others and are not held out.  Repeated
rows are kept; repeated labels of an id count by their largest value, and of
several texts of a labelled id the smallest takes part.  Without labelled rows of
both kinds the lexicon alone decides: 0.1 without a hit, over 0.9 with one.
Columns named score and predicted are replaced, all others stay.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

LEXICON = ("clown", "disgusting", "dumb", "filth", "garbage", "idiot", "imbecile", "loser", "moron", "pathetic", "pig", "scum", "stupid", "trash", "vermin", "worthless")
MAX_LABELLED = 8_000
PATTERNS = 240
HASHED = 1 << 15
THRESHOLD = 0.7
#: Where the estimate of a given label's accuracy starts.
TRUST = 0.9
#: Letters of the word beginnings that serve as patterns.
BEGINNINGS = (4, 5, 6, 7)
#: Least numbers of occurrences, and least shares in per cent of words, of a pattern.
LEAST, SHARE = (2, 4, 8), (1, 3)
WORD = re.compile(r"\w+")


def parts(word: str) -> list[str]:
    return [word, *(f"^{word[:k]}" for k in BEGINNINGS if len(word) > k)]


def words(text: str | None) -> Counter[str]:
    return Counter(WORD.findall(text.lower())) if text else Counter()


def key(name: str) -> int:
    """Voters are known by the crc32 of their name."""
    return zlib.crc32(name.encode("utf-8", "replace"))


def further(mark: str, numbers: tuple[int, ...]) -> list[tuple[int, bytes]]:
    return [(k, f"{mark}{k}".encode()) for k in numbers]


#: What follows a part in the names of its voters; a crc32 goes on from that of the part.
OF_LEAST, OF_SHARE = further("#", LEAST), further("%", SHARE)
ENDS = [end for _, end in OF_LEAST + OF_SHARE]


def levels(part: str, count: int, total: int) -> list[int]:
    """The voters that fire for ``count`` words with ``part`` out of ``total``."""
    base = key(part)
    out = [base]
    out += [zlib.crc32(end, base) for k, end in OF_LEAST if count >= k]
    out += [zlib.crc32(end, base) for k, end in OF_SHARE if count * 100 >= k * total]
    return out


def fired_by(counts: Counter[str], total: int) -> list[int]:
    return [v for p, c in counts.items() for v in levels(p, c, total)]


def part_counts(bag: Counter[str]) -> Counter[str]:
    out: Counter[str] = Counter()
    for w, c in bag.items():
        for p in parts(w):
            out[p] += c
    return out


def slots(word: str) -> list[int]:
    return [zlib.crc32(p.encode("utf-8", "replace")) % HASHED for p in parts(word)]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 per row, the shares of the voters, and the accuracies of the given label under 0 and 1.

    A voter that does not fire votes, weakly, for the label under which it fires
    less.  The balance of the hidden labels is held at that of the given ones.
    """
    v = votes.astype(float)
    k = v.shape[1]
    balance = np.log(given.mean()) - np.log(1 - given.mean())
    post = np.where(given == 1, TRUST, 1 - TRUST)
    for _ in range(rounds):
        w1, w0 = post.sum(), (1 - post).sum()
        p1, p0 = (post @ v + 0.5) / (w1 + 1), ((1 - post) @ v + 0.5) / (w0 + 1)
        # what the hidden label leaves of the voters' agreement
        second = v.T @ v - np.outer(p1, p1) * w1 - np.outer(p0, p0) * w0
        sd = np.sqrt(np.clip(np.diag(second), 0, None)) + 1e-6
        corr = np.clip(second / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(corr, 1)
        share = 1 / np.where(corr > 0.1, corr, 0).sum(1)
        silent = np.log1p(-p1) - np.log1p(-p0)
        logit = v @ (share * (np.log(p1) - np.log(p0) - silent)) + (share * silent).sum() + balance
        others = sigmoid(logit)
        # accuracies of the given label by its agreement with the others, never with itself
        right = np.array([((1 - others) @ (given == 0) + 9) / ((1 - others).sum() + 10), (others @ (given == 1) + 9) / (others.sum() + 10)])
        label = np.where(given == 1, np.log(right[1]) - np.log(1 - right[0]), np.log(1 - right[1]) - np.log(right[0]))
        new = sigmoid(logit + label)
        still = np.abs(new - post).max() < 1e-6
        post = new
        if still:
            break
    return post, share, right


@dataclass
class Model:
    voters: dict[int, int]
    weights: np.ndarray  # voters, then hashed parts, then bias

    def scorer(self):
        """Score of a text; what a word and a part of words weigh is remembered, as few of them are new in a text."""
        voters, k, w = self.voters, len(self.voters), self.weights.tolist()
        firing: dict[str, tuple] = {}  # parts with voters: their weights at any count, from counts on, from shares on

        def of_voter(v: int) -> float:
            return w[voters[v]] if v in voters else 0.0

        known = frozenset(voters)

        def weight_of(part: str) -> float:
            base = key(part)
            if not known.isdisjoint([base, *[zlib.crc32(end, base) for end in ENDS]]):
                later = [[(n, of_voter(zlib.crc32(end, base))) for n, end in ends] for ends in (OF_LEAST, OF_SHARE)]
                firing[part] = (of_voter(base), *later)
            return w[k + base % HASHED]

        beginnings = bpe.Words(weight_of)

        def of(word: str) -> tuple[tuple[str, ...], float]:
            held = parts(word)
            weight = weight_of(word) + sum([beginnings[p] for p in held[1:]])
            return () if firing.keys().isdisjoint(held) else tuple([p for p in held if p in firing]), weight

        of_word = bpe.Words(of)

        def score(text: str | None) -> float:
            bag = words(text)
            counts: dict[str, int] = {}
            values = []
            for word, n in bag.items():
                hits, weight = of_word[word]
                for p in hits:
                    counts[p] = counts.get(p, 0) + n
                values.append(weight if n == 1 else weight * n**0.5)
            size = bag.total()
            votes = []
            for p, n in counts.items():
                always, by_least, by_share = firing[p]
                votes.append(always)
                votes += [x for least, x in by_least if n >= least]
                votes += [x for share, x in by_share if n * 100 >= share * size]
            # exact sums do not depend on the order of words
            return float(sigmoid(w[-1] + math.fsum(votes) + math.fsum(values) / max(size, 1) ** 0.5))

        return score


@dataclass
class Rows:
    """Training rows as numbers."""

    voters: list[int]
    y: np.ndarray
    votes: np.ndarray  # rows x voters
    row: np.ndarray  # hashed parts: row, slot and value of each
    col: np.ndarray
    val: np.ndarray

    def only(self, keep: np.ndarray) -> Rows:
        place = np.cumsum(keep) - 1
        some = keep[self.row]
        return Rows(self.voters, self.y[keep], self.votes[keep], place[self.row[some]].astype(np.int32), self.col[some], self.val[some])


def lexicon_model() -> Model:
    voters = {key(p): i for i, p in enumerate(LEXICON)}
    return Model(voters, np.concatenate([np.full(len(voters), 4.6), np.zeros(HASHED), [-2.2]]))


def fit(rows: Rows) -> Model:
    """The model of all rows, its bias moved to where the threshold did best on rows left out.

    A third of the rows is scored by a model of the others; among the cuts of
    those scores the one with the best F1 becomes the threshold.
    """
    y = rows.y
    if not 0 < y.sum() < len(y):
        return lexicon_model()
    out = np.arange(len(y)) % 3 == 0
    shift = 0.0
    if 5 <= y[out].sum() < out.sum() and 5 <= y[~out].sum() < (~out).sum():
        w = train(rows.only(~out))
        left = rows.only(out)
        z = margins(left, w)
        order = np.argsort(-z, kind="stable")
        hits = np.cumsum(left.y[order])
        best = int(np.argmax(2 * hits / (np.arange(1, len(z) + 1) + left.y.sum())))
        shift = np.log(THRESHOLD / (1 - THRESHOLD)) - (z[order[best]] + z[order[min(best + 1, len(z) - 1)]]) / 2
    w = train(rows)
    w[-1] += shift
    return Model({v: i for i, v in enumerate(rows.voters)}, w)


def margins(r: Rows, w: np.ndarray) -> np.ndarray:
    k = len(r.voters)
    return r.votes @ w[:k] + np.bincount(r.row, r.val * w[k:-1][r.col], minlength=len(r.y)) + w[-1]


def train(r: Rows, rounds: int = 100, penalty: float = 2e-4) -> np.ndarray:
    """Weights of the linear classifier on the posterior labels."""
    k, n = len(r.voters), len(r.y)
    target = label_model(r.votes, r.y)[0]
    w, v, b = np.zeros(k), np.zeros(HASHED), float(np.log(target.mean() / (1 - target.mean())))
    # the rarer label counts more, so that its rows reach the threshold
    cost = 1 + (min(8.0, (1 - target.mean()) / target.mean()) - 1) * target
    x = r.votes.astype(np.float32)
    m = [np.zeros(k), np.zeros(HASHED), 0.0, np.zeros(k), np.zeros(HASHED), 0.0]
    for t in range(1, rounds + 1):  # Adam on the mean log loss
        z = x @ w + np.bincount(r.row, r.val * v[r.col], minlength=n) + b
        d = cost * (sigmoid(z) - target) / n
        grads = (x.T @ d + penalty * w, np.bincount(r.col, r.val * d[r.row], minlength=HASHED) + penalty * v, d.sum())
        step = []
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            m[i + 3] = 0.99 * m[i + 3] + 0.01 * g * g
            step.append(0.05 * (m[i] / (1 - 0.9**t)) / (np.sqrt(m[i + 3] / (1 - 0.99**t)) + 1e-8))
        w, v, b = w - step[0], v - step[1], b - step[2]
    return np.concatenate([w, v, [b]])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Rows:
    """Features of the labelled rows that may be learnt from; two passes over their texts, on executors."""
    spark = docs.sparkSession
    common.small_batches(spark)
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1))
    marks = marks.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    # the bound of max_labelled rows makes the small side
    some = common.written(F.broadcast(marks).join(src, "id").groupBy("id").agg(F.min("y").alias("y"), F.min(F.coalesce("text", F.lit(""))).alias("text")), "training-rows")

    def count(batches):
        import pyarrow as pa

        common.lean()
        seen: tuple[Counter[int], Counter[int]] = (Counter(), Counter())
        for b in batches:
            for y, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                bag = words(text)
                seen[y].update(set(fired_by(part_counts(bag), sum(bag.values()))))
        names = list(seen[0].keys() | seen[1].keys())
        for a in range(0, len(names), 100_000):
            part = names[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([seen[1][v] for v in part], pa.int64()), pa.array([seen[0][v] for v in part], pa.int64())], ["voter", "a", "b"])

    n1, n0 = (int(x or 0) for x in some.agg(F.sum("y"), F.sum(1 - F.col("y"))).first())
    counts = some.select("y", "text").mapInArrow(count, "voter long, a long, b long").groupBy("voter").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a + b >= 5")
    z = (F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))) / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    scored = common.written(counts.select("voter", z.alias("z")), "voters")
    up = scored.where("z > 2").orderBy(F.desc("z"), "voter").limit(PATTERNS // 2).collect()
    down = scored.where("z < -2").orderBy("z", "voter").limit(PATTERNS // 2).collect()
    common.dropped(scored)
    voters = list(dict.fromkeys([*map(key, LEXICON), *(r["voter"] for r in up), *(r["voter"] for r in down)]))
    place = {v: i for i, v in enumerate(voters)}

    def features(batches):
        import pyarrow as pa

        of_word = bpe.Words(slots)
        for b in batches:
            votes, cols, vals = [], [], []
            for text in b.column(2).to_pylist():
                bag = words(text)
                size = sum(bag.values())
                votes.append(sorted({place[v] for v in fired_by(part_counts(bag), size) if v in place}))
                got: Counter[int] = Counter()
                for w in sorted(bag):
                    for s in of_word[w]:
                        got[s] += bag[w] ** 0.5
                cols.append(list(got))
                vals.append([x / max(size, 1) ** 0.5 for x in got.values()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(votes, pa.list_(pa.int32())), pa.array(cols, pa.list_(pa.int32())), pa.array(vals, pa.list_(pa.float32()))], ["id", "y", "votes", "cols", "vals"])

    got = some.select("id", "y", "text").mapInArrow(features, "id long, y int, votes array<int>, cols array<int>, vals array<float>").toArrow().combine_chunks()
    common.dropped(some)
    got = got.take(np.argsort(got.column("id").to_numpy(), kind="stable"))
    lists = {c: got.column(c).combine_chunks() for c in ("votes", "cols", "vals")}
    rows = lambda c: np.repeat(np.arange(len(got), dtype=np.int32), lists[c].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    votes = np.zeros((len(got), len(voters)), bool)
    votes[rows("votes"), lists["votes"].flatten().to_numpy()] = True
    return Rows(voters, got.column("y").to_numpy().astype(np.int64), votes, rows("cols"), lists["cols"].flatten().to_numpy(), lists["vals"].flatten().to_numpy())


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with columns score and predicted added (both replace columns of that name)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # a few hundred kilobytes, whatever the corpus
    base = docs.drop("score", "predicted")
    src = base.select(F.struct(*base.columns).alias("row"), base[text_col].cast("string").alias("text"))
    kind = src.schema["row"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        common.lean()
        score = held.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(t) for t in b.column(1).to_pylist()], pa.float64())], ["row", "score"])

    out = src.mapInArrow(run, f"row {kind}, score double")
    return out.select("row.*", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(training_rows(docs, common.read_table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")

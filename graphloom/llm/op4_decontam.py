"""Benchmark decontamination: rare seeds, then Smith-Waterman alignment.

Every run of ``seed`` words of a test item is counted over all documents; the
rarest that occur, as many as half of an item's seeds, ``least`` at least, join
passages to the item.  Around the diagonal that its seed hits name, the passage is aligned to
the whole item by words (match +2, mismatch and gap -1); the score is the best
local alignment over the item's perfect score.  Two hits are enough, one if the
item has fewer than two seeds, and every diagonal band with hits is aligned.

Test items are broadcast in slices of at most ``SLICE_CHARS`` characters, so that
a large benchmark costs further passes over the documents, not memory.

Words are runs of letters and digits, lower-cased.  Null and empty texts and
items match nothing; items of fewer words than a seed are looked for as one seed.
Repeated rows give repeated matches.  Null ids are kept.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED = 3
LEAST_SEEDS = 6
SCORE = 0.5
SLICE_CHARS = 4_000_000
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams(ws: list[str], n: int) -> list[str]:
    return [" ".join(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))] if ws else []


def align(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """Best local alignment of ``a`` with ``b``: (score, start in b, end in b)."""
    codes = {w: i for i, w in enumerate(dict.fromkeys(a))}
    bb = np.array([codes.get(w, -1) for w in b])
    n = len(b)
    row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, ramp = (0, 0, 0), np.arange(n + 1)
    for w in a:
        diag = row[:-1] + np.where(bb == codes[w], 2, -1)
        cand = np.concatenate([[0], np.maximum(np.maximum(diag, row[1:] - 1), 0)])
        from_ = np.concatenate([[0], np.where(cand[1:] == 0, ramp[1:], np.where(diag >= row[1:] - 1, start[:-1], start[1:]))])
        lift = np.maximum.accumulate(cand + ramp)  # gaps along b
        new = lift - ramp
        at = np.maximum.accumulate(np.where(cand + ramp == lift, ramp, 0))
        start = np.where(new > 0, from_[at], ramp)
        row = new
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), int(start[j]), j)
    return best


def seed_lengths(items, seed: int) -> list[int]:
    """Words in the seeds of the items (id, words, ...): ``seed``, and fewer where an item is that short."""
    return sorted({min(seed, len(i[1])) for i in items})


class Matcher:
    def __init__(self, items: list[tuple[int, list[str], list[str]]], seed: int, threshold: float):
        self.items, self.seed, self.threshold = items, seed, threshold
        self.lengths = seed_lengths(items, seed)
        self.index: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, ws, chosen) in enumerate(items):
            want = set(chosen)
            for at, g in enumerate(grams(ws, seed)):
                if g in want:
                    self.index[g].append((k, at))

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, score, first word, end word) of every item in the text, the best passage each."""
        ws = words(text)
        if not ws:
            return []
        found: dict[int, list[int]] = defaultdict(list)
        for n in self.lengths:
            for at, g in enumerate(zip(*(ws[i:] for i in range(n)), strict=False)):
                for k, pos in self.index.get(" ".join(g), ()):
                    found[k].append(at - pos)
        out = []
        for k, diagonals in found.items():
            item, mine, chosen = self.items[k]
            if len(diagonals) < min(2, len(chosen)):
                continue
            diagonals.sort()
            slack, best, i = len(mine) // 2 + 2, (0.0, 0, 0), 0
            while i < len(diagonals):
                j = i
                while j + 1 < len(diagonals) and diagonals[j + 1] - diagonals[i] <= slack:
                    j += 1
                lo = max(0, diagonals[i] - slack)
                score, a, b = align(mine, ws[lo : diagonals[j] + len(mine) + slack])
                best = max(best, (score / (2 * len(mine)), lo + a, lo + b))
                i = j + 1
            if best[0] >= self.threshold:
                out.append((item, *best))
        return sorted(out)


def slices(bench: DataFrame, item_col: str, text_col: str, chars: int = SLICE_CHARS):
    """Lists of (item, words), each of at most ``chars`` characters and one item."""
    held, size = [], 0
    rows = bench.select(bench[item_col].cast("long"), bench[text_col].cast("string")).where(F.length(bench[text_col]) > 0).distinct().orderBy(item_col, text_col)
    for item, text in rows.toLocalIterator():
        if held and size + len(text) > chars:
            yield held
            held, size = [], 0
        held.append((item, words(text)))
        size += len(text)
    if held:
        yield held


def rarest(gs: list[str], df: dict[str, int], least: int) -> list[str]:
    """The seeds that join: as many as half of an item's, ``least`` at least, the rarest of those that occur in documents at all."""
    every = sorted(set(gs), key=lambda g: (df.get(g, 0), g))
    return [g for g in every if df.get(g, 0)][: max(least, -(-len(every) // 2))]


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", seed: int = SEED, least: int = LEAST_SEEDS, threshold: float = SCORE) -> DataFrame:
    """(id_col, key, item_id, score, first_word, end_word) of every match; key is the hash of the text."""
    spark = docs.sparkSession
    common.small_batches(spark)
    src = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("key"), docs[text_col].cast("string").alias("text")).where("length(text) > 0")
    schema = "id long, key long, item_id long, score double, first_word long, end_word long"
    out = spark.createDataFrame([], schema)
    for items in slices(bench, item_col, item_text):
        items = [(i, ws) for i, ws in items if ws]
        wanted = spark.sparkContext.broadcast({g for _, ws in items for g in grams(ws, seed)})

        lengths = seed_lengths(items, seed)

        def count(batches, wanted=wanted, lengths=lengths):
            import pyarrow as pa

            common.lean()
            seen, want = Counter(), wanted.value
            for b in batches:
                for text in b.column(0).to_pylist():
                    ws = words(text)
                    seen.update(g for n in lengths for g in map(" ".join, zip(*(ws[i:] for i in range(n)), strict=False)) if g in want)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["gram", "n"])

        df = {r[0]: r[1] for r in src.select("text").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n")).collect()}
        chosen = []
        for i, ws in items:
            chosen.append((i, ws, rarest(grams(ws, seed), df, least)))
        held = spark.sparkContext.broadcast(Matcher(chosen, seed, threshold))

        def match(batches, held=held):
            import pyarrow as pa

            for b in batches:
                rows = [(i, k, *m) for i, k, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for m in held.value.matches(t)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) if n == 3 else pa.array(c, pa.int64()) for n, c in enumerate(zip(*rows, strict=True))], ["id", "key", "item_id", "score", "first_word", "end_word"])

        out = out.union(src.mapInArrow(match, schema))
    return out.select(F.col("id").alias(id_col), "key", F.col("item_id").alias("item_id"), "score", "first_word", "end_word")


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that hold a test item."""
    ids, keys = common.free_name(docs, "found_id"), common.free_name(docs, "found_key")
    bad = contamination(docs, bench, id_col, text_col, **how).select(F.col(id_col).alias(ids), F.col("key").alias(keys)).distinct()
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col(ids)) & (F.xxhash64(docs[text_col]) == F.col(keys)), "left_anti")


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents", "doc_id", "text")
    return contamination(docs, common.read_table(spark, sf_dir, "benchmark")).drop("key")

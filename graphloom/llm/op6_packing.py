"""Packing of documents into fixed windows by non-negative least squares.

Every document is cut into whole windows and one remainder shorter than a
window.  The histogram of remainder lengths (at most ``window`` bins, whatever
the corpus) is all that the driver sees.  There, shallow combinations of two or
three lengths that fill a window are enumerated; non-negative least squares
gives the number of times that each is repeated; the numbers are rounded within
what the histogram holds, and a greedy best fit packs the rest.  The outcome is
a list of slots: "remainders of length l with ranks r0 to r1 go to sequences
s0 onward at this offset".  Ranks within a length come from a range-sorted
table and per-partition counts, so a length that holds a third of all documents
is still spread over tasks, and no row ever passes through the driver.

Null text counts as empty (the end id alone).  Repeated rows and null ids are
packed like any other row, very long texts are cut into whole windows.  Columns
other than id and text are left out.  An empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
WINDOW = 1024
#: Combinations of three lengths that are tried beside all pairs.
TRIPLES = 4096
ROUNDS = 400


def combinations(window: int, triples: int = TRIPLES) -> np.ndarray:
    """Rows of three lengths, 0 for none, that sum to ``window``.

    All pairs, and the triples whose two shorter lengths lie on the finest grid
    that gives at most ``triples`` of them.
    """
    pairs = [(a, window - a, 0) for a in range(1, window // 2 + 1)]
    step = 1
    while True:
        grid = range(step, window, step)
        some = [(a, b, window - a - b) for a in grid for b in grid if a <= b <= window - a - b]
        if len(some) <= triples:
            return np.array(pairs + some, dtype=np.int64)
        step += 1


def solve_repeats(hist: np.ndarray, combos: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """argmin over x >= 0 of |A x - hist|, A's columns the combinations.

    Accelerated projected gradient; A has three entries a column and is never
    built.
    """
    bins = len(hist)

    def forward(x):
        got = np.zeros(bins)
        for k in range(3):
            got += np.bincount(combos[:, k], weights=x, minlength=bins)
        got[0] = 0
        return got

    def backward(r):
        r = r.copy()
        r[0] = 0
        return r[combos[:, 0]] + r[combos[:, 1]] + r[combos[:, 2]]

    v = np.ones(len(combos))
    for _ in range(20):  # largest eigenvalue of A'A
        v = backward(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(backward(forward(v))))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * backward(forward(y) - hist))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan_slots(hist: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, r0, r1, s0, offset) that cover every remainder once.

    ``hist[l]`` remainders have length l.  Remainder number r of a length, with
    r0 <= r < r1, goes to sequence s0 + r - r0.  The number of slots depends on
    the window, not on the corpus.
    """
    left = hist.astype(np.int64).copy()
    left[0] = 0
    used = np.zeros_like(left)
    slots: list[tuple[int, int, int, int, int]] = []
    seq = 0

    def place(lengths: list[int], k: int) -> None:
        nonlocal seq
        offset = 0
        for n in lengths:
            slots.append((n, int(used[n]), int(used[n] + k), seq, offset))
            used[n] += k
            left[n] -= k
            offset += n
        seq += k

    if left.sum():
        combos = combinations(window)
        repeats = np.floor(solve_repeats(left.astype(float), combos) + 0.5).astype(np.int64)
        for i in np.argsort(-repeats, kind="stable"):
            if repeats[i] <= 0:
                break
            lengths = [int(n) for n in combos[i] if n]
            k = min(int(repeats[i]), *(int(left[n]) // lengths.count(n) for n in lengths))
            if k > 0:
                place(lengths, k)
    while True:  # greedy: the longest first, each time the longest that still fits
        have = np.nonzero(left)[0]
        if not len(have):
            return slots
        lengths, space, mine = [], window, left.copy()
        while space > 0:
            fit = np.nonzero(mine[: space + 1])[0]
            if not len(fit):
                break
            lengths.append(int(fit[-1]))
            mine[fit[-1]] -= 1
            space -= int(fit[-1])
        place(lengths, min(int(left[n]) // lengths.count(n) for n in set(lengths)))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """Pieces (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Sequences hold at most ``window`` ids; what a sequence lacks is padding.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    tok = tokenizer_file or bpe.tokenizer_path(TOKENIZER)
    end = int(end_id).to_bytes(4, "little")

    def measure(batches):
        import pyarrow as pa

        coder, size = bpe.batch_coder(tok), 4 * window
        for b in batches:
            tokens, crcs = [], []
            for ids in coder.encode(b.column(1)):
                ids += end
                tokens.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i : i + size]) for i in range(0, len(ids), size)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["id", "tokens", "crcs"])

    def number(batches):
        """Place of every row among its partition's rows of the same length, and whole windows before it."""
        import pyarrow as pa
        from pyspark import TaskContext

        part, seen, whole = TaskContext.get().partitionId(), {}, 0
        for b in batches:
            ranks, before = [], []
            for n in b.column(1).to_pylist():
                r = n % window
                ranks.append(seen.get(r, 0))
                seen[r] = ranks[-1] + 1
                before.append(whole)
                whole += n // window
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(ranks, pa.int64()), pa.array(before, pa.int64())], ["id", "tokens", "crcs", "part", "rank", "before"])

    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    measured = common.written(src.mapInArrow(measure, "id long, tokens long, crcs array<long>"), "pack-lengths")
    rem = F.col("tokens") % window
    ranged = measured.repartitionByRange(common.width(spark), rem, F.col("id"), F.col("crcs")[0]).sortWithinPartitions(rem, "id", F.col("crcs")[0])
    placed = common.written(ranged.mapInArrow(number, "id long, tokens long, crcs array<long>, part int, rank long, before long"), "pack-ranks")

    # at most partitions + window rows: the table is range-sorted by remainder
    counts = sorted(tuple(r) for r in placed.groupBy("part", rem.cast("int").alias("rem")).agg(F.count("*").alias("n"), F.sum(F.expr(f"tokens div {window}")).alias("whole")).collect())
    hist, base, whole, wholes = np.zeros(window, np.int64), {}, {}, 0
    for part, r, n, w in counts:
        base[part, r] = int(hist[r])
        hist[r] += n
        whole.setdefault(part, wholes)
        wholes += w
    by_length: dict[int, tuple] = {}
    slots = sorted(plan_slots(hist, window))
    for n in {s[0] for s in slots}:
        mine = [s for s in slots if s[0] == n]
        by_length[n] = tuple(np.array([s[k] for s in mine], np.int64) for k in (1, 3, 4))

    def place(batches):
        import pyarrow as pa

        names = ["id", "start", "length", "crc", "tokens", "sequence_id", "offset"]
        for b in batches:
            rows: list[tuple] = []
            for doc, n, crcs, part, rank, before in zip(*(c.to_pylist() for c in b.columns), strict=True):
                full, r = divmod(n, window)
                rows += [(doc, j * window, window, crcs[j], n, whole[part] + before + j, 0) for j in range(full)]
                if r:
                    r0, s0, offset = by_length[r]
                    at = base[part, r] + rank
                    i = int(np.searchsorted(r0, at, side="right")) - 1
                    rows.append((doc, full * window, r, crcs[full], n, wholes + int(s0[i]) + at - int(r0[i]), int(offset[i])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    out = placed.mapInArrow(place, "id long, start long, length long, crc long, tokens long, sequence_id long, offset long")
    return out.select(F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read_table(spark, sf_dir, "documents", "doc_id", "text"))

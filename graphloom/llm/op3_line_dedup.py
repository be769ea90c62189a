"""Line deduplication by an exact set-similarity join.

Lines are what stands between ``\\n``.  A line's tokens are its distinct 5-word
shingles (A-Z lower-cased): near-duplicate operators here go by five words and a
Jaccard similarity of 0.8.  A line of fewer words has all of them as its one
token, so it matches only lines of the same words; only lines without a word are
never compared.  A line of equal set to an earlier one goes.  Of the others,
those stay in play that share as many of the first few of their tokens by hash
with other lines as any match would (:func:`setjoin.sieve`).  Over all of these
:mod:`setjoin` orders tokens by rarity and brings lines that share a prefix
token into slices.  There the prefix, length
and positional filters (PPJoin: Xiao et al., WWW 2008) leave candidates whose
Jaccard similarity is then verified.  A line that matches an earlier one, in the
order (id, line number), at 0.8 or more is removed, whether or not the earlier
one was removed itself.

Equal line sets are one class that takes part with its first occurrence.  Rows
with a null id stay as they are and are not compared.  Null text stays null, an
empty one empty; very long texts and lines are compared whole.  Repeated rows
(same id and text) count as one and are all kept, cleaned alike; rows that share
an id but not a text are ordered by the hash of their text.  A document that
loses all its lines keeps an empty text.  All columns stay, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, setjoin, words
from .op5_ngram_join import PERCENT, SHINGLE, slice_columns


def matched_earlier(ids: list[int], sizes: list[int], lengths: list[int], sets: list[list[int]], asks: list[bool], percent: int) -> list[int]:
    """Ids of the sets that ask and match one with a smaller id (PPJoin over ids in order).

    ``sets`` hold the shared tokens in the order of rarity, ``lengths`` how many
    of them the prefix holds, ``sizes`` all tokens.
    """
    index: dict[int, list[tuple[int, int]]] = {}  # token -> (set, place of the token from the end)
    whole: dict[int, frozenset[int]] = {}
    out = []

    def tokens_of(r: int) -> frozenset[int]:
        if r not in whole:
            whole[r] = frozenset(sets[r])
        return whole[r]

    def match(q: int, r: int) -> bool:
        n, m = sizes[q], sizes[r]
        return min(n, m) * 100 >= percent * max(n, m) and setjoin.linked(len(tokens_of(q) & tokens_of(r)), n, m, percent)

    for q in sorted(range(len(ids)), key=ids.__getitem__):
        mine, n = sets[q], sizes[q]
        prefix = mine[: lengths[q]]
        if asks[q]:
            near = {index[t][-1][0] for t in prefix if t in index}  # the newest of each list first: near copies end here
            hit = any(match(q, r) for r in near)
            if not hit:
                seen: dict[int, int] = {}
                for i, t in enumerate(prefix):
                    for r, behind in index.get(t, ()):
                        m = sizes[r]
                        if r in near or min(n, m) * 100 < percent * max(n, m):
                            continue  # length filter
                        a = seen.get(r, 0)
                        # positional filter: what is shared so far and could still come
                        seen[r] = a + 1 if a >= 0 and (a + 1 + min(len(mine) - i - 1, behind)) * (100 + percent) >= percent * (n + m) else -1
                hit = any(a > 0 and match(q, r) for r, a in seen.items())
            if hit:
                out.append(ids[q])
        for i, t in enumerate(prefix):
            index.setdefault(t, []).append((q, len(mine) - i - 1))
    return out


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, rounds: int = setjoin.ROUNDS) -> DataFrame:
    """(id, key, lines): numbers of the lines that go, per document and hash of its text."""
    spark = docs.sparkSession
    common.small_batches(spark)

    def make(b, wanted=None):
        """Sets of all lines, or of those whose places are in the filter ``wanted``."""
        data, at = words.raw(b.column(2))
        h, start, _ = words.words(data, at)
        ends = np.flatnonzero(data == 10)
        row = words.owners(at, start)
        line = np.searchsorted(ends, start) + row  # lines of all rows, one after the other
        count = len(ends) + b.num_rows
        before = np.searchsorted(ends, at[:-1])  # lines of the rows before
        of = np.repeat(np.arange(b.num_rows), np.diff(np.r_[before, len(ends)]) + 1)
        meta = np.zeros(count, setjoin.META)
        meta["id"], meta["key"] = b.column(0).to_numpy()[of], b.column(1).to_numpy()[of]
        meta["line"] = np.arange(count) - (before + np.arange(b.num_rows))[of]
        if wanted is not None:
            some = setjoin.in_filter(wanted, setjoin.place_hash(meta))[line]
            h, line = h[some], line[some]
        tokens, offsets = words.sets_of(h, line, count, shingle)
        meta["n"] = np.diff(offsets)
        d = words.digests(tokens, offsets)
        meta["d0"], meta["d1"] = d[:, 0], d[:, 1]
        return meta, tokens, offsets

    def take(batches):
        import pyarrow as pa

        common.lean()
        names = ["id", "key", "line", "n", "members", "sets", "token", "times"]
        for b in batches:
            meta, tokens, at = make(b, held.value)
            for meta, tokens, at in setjoin.pieces(*setjoin.kept(meta, tokens, at, setjoin.firsts(meta)[0])):
                yield pa.RecordBatch.from_arrays([pa.array(meta[c]) for c in ("id", "key", "line", "n")] + [setjoin._binary(tokens, at[1:]), *(pa.nulls(len(meta), pa.int64()) for _ in range(3))], names)
                hot, times = setjoin.hot_here(tokens, len(meta))
                extra = [pa.array([len(meta)] + [None] * len(hot), pa.int64()), pa.array([None, *hot.tolist()], pa.int64()), pa.array([None, *times.tolist()], pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.nulls(1 + len(hot), k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())] + extra, names)

    def again(b):
        meta = np.zeros(b.num_rows, setjoin.META)
        for k, c in enumerate(("id", "key", "line", "n")):
            meta[c] = b.column(k).to_numpy()
        tokens, at = words.raw(b.column(4))
        tokens, at = tokens.view(np.uint64), at // 8
        d = words.digests(tokens, at)
        meta["d0"], meta["d1"] = d[:, 0], d[:, 1]
        return meta, tokens, at

    text = docs[text_col].cast("string")
    src = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    copies, left = setjoin.sieve(src, make, percent, src.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    held = spark.sparkContext.broadcast(setjoin.filter_of(left))  # at most 32 MB
    common.dropped(left)
    common.released(spark)
    measured = common.written(src.mapInArrow(take, "id long, key long, line int, n int, members binary, sets long, token long, times long"), "likely-sets")
    likely = measured.where("id IS NOT NULL").select("id", "key", "line", "n", "members")
    total = likely.agg(F.sum("n")).first()[0] or 0
    shared = setjoin.shared_tokens(likely, again, total, setjoin.hot_tokens(measured.where("id IS NULL").select("sets", "token", F.col("times").alias("n"))))
    common.dropped(measured)
    sets = setjoin.classes(setjoin.candidates(shared, percent), numbered=True)
    common.dropped(shared)
    common.released(spark)

    def work(t):
        import pyarrow as pa

        sid, n, length, tokens, _, asks = slice_columns(t)
        gone = matched_earlier(sid, n, length, [x.tolist() for x in tokens], asks, percent)
        if gone:
            return pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], ["sid"])

    found = setjoin.join_sets(sets, work, True, percent, "sid long", lambda f: f.distinct(), rounds)
    out = copies if found is None else copies.union(sets.join(found.distinct(), "sid").select("id", "key", "line"))
    result = common.written(out.groupBy("id", "key").agg(F.array_sort(F.collect_set("line")).alias("lines")), "removed-lines")
    common.dropped(copies, sets)
    common.released(spark)
    return result


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the text cleaned, all columns and rows kept."""
    gone = removed_lines(docs, id_col, text_col, **how)
    text = docs[text_col].cast("string")
    named = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("key"))
    joined = named.join(gone.hint("shuffle_hash"), ["id", "key"], "left")  # texts are not sorted
    # numbers of removed lines as keys of a map: one look-up a line
    marked = joined.withColumn("marks", F.map_from_arrays("lines", F.transform("lines", lambda _: F.lit(True))))
    kept = F.array_join(F.filter(F.split(F.col("row")[text_col], "\n", -1), lambda _, i: F.col("marks")[i].isNull()), "\n")
    return marked.select(*(F.when(F.col("lines").isNotNull(), kept).otherwise(F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents", "doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))

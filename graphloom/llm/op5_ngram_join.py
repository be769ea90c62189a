"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document's set holds its distinct 5-word shingles (words between ASCII white
space, A-Z lower-cased).  A match of a set of n shingles shares at least T =
ceil(0.8 n) of them.  :mod:`setjoin` brings sets that may match into slices.
There every set is a query against the inverted lists of the slice, by
DivideSkip (Li, Lu, Lu, ICDE 2008): L of the query's lists, the longest, are set
aside, L by the cost rule T / (MU log2 M + 1) with M the longest list's length;
the others are merged with a heap (many entries are counted at once, to the same
numbers), and a document met there at least T - L times is sought in the long
lists by binary search until it has, or can no longer have, the overlap that its
size asks for.  Those met most often are probed first.

A query looks for no link to its own component and leaves another one with the
first link into it: a group of near copies yields a spanning forest, never all
its pairs.

Documents with equal sets are one class, which takes part once.  Null, empty and
blank texts have an empty set and are linked with nothing; very long texts are
whole sets like others.  Rows that share an id but not a text are one vertex for
each text: their links are joined under the id, and each row has its own number
of shingles.  Null ids give rows whose component is that of their class, or
null.  Repeated rows are kept.  Columns other than id and text are left out.
"""

from __future__ import annotations

import heapq
import math
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, setjoin, words

SHINGLE = 5
PERCENT = 80
#: Cost of a binary search against one of a merge step, in the rule for L.
MU = 0.01


def long_lists(need: int, longest: int) -> int:
    """How many of a query's lists are probed instead of merged."""
    return max(0, min(need - 1, int(need / (MU * math.log2(longest + 1) + 1))))


class Lists:
    """Inverted lists of a slice: places of the sets that hold a token, ascending; tokens of one set are left out."""

    def __init__(self, sets: list[np.ndarray]):
        tokens = np.concatenate([np.zeros(0, np.int64), *sets])
        place = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        ordered = tokens[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        times = np.diff(np.r_[starts, len(ordered)])
        self.places = place[order]
        first = np.repeat(starts, times)
        begin, rank, many = np.empty(len(tokens), np.int64), np.empty(len(tokens), np.int64), np.empty(len(tokens), bool)
        begin[order], rank[order], many[order] = first, np.arange(len(tokens)) - first, np.repeat(times > 1, times)
        ends = np.cumsum([len(s) for s in sets])
        #: Per set: where each of its lists begins, and how many earlier sets stand in it.
        self.of = [(begin[a:z][many[a:z]], rank[a:z][many[a:z]]) for a, z in zip(np.r_[0, ends[:-1]], ends, strict=True)]

    def merged(self, begin: np.ndarray, length: np.ndarray, sets: int) -> np.ndarray:
        """How many of the lists hold each of the first ``sets`` places: by a heap, or, of many entries, by counting them all at once."""
        if length.sum() > HEAP_ENTRIES:
            return np.bincount(np.concatenate([self.places[b : b + n] for b, n in zip(begin.tolist(), length.tolist(), strict=True)]), minlength=sets)
        counts = np.zeros(sets, np.int64)
        for i, same in groupby(heapq.merge(*(self.places[b : b + n].tolist() for b, n in zip(begin.tolist(), length.tolist(), strict=True)))):
            counts[i] = sum(1 for _ in same)
        return counts

    def probed(self, found: np.ndarray, counts: np.ndarray, least: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Which of ``found`` reach ``least``: binary search in the long lists, until it is reached or out of reach."""
        sure = []
        left = len(begin)
        for b, n in zip(begin.tolist(), length.tolist(), strict=True):
            done = counts >= least
            sure.append(found[done])
            open_ = ~done & (counts + left >= least)
            if not open_.all():
                found, counts, least = found[open_], counts[open_], least[open_]
            if not len(found):
                break
            here = self.places[b : b + n]
            at = np.minimum(np.searchsorted(here, found), n - 1)
            counts = counts + (here[at] == found)
            left -= 1
        return np.concatenate([*sure, found[counts >= least]])


#: Entries of short lists beyond which they are counted at once instead of merged by a heap.
HEAP_ENTRIES = 256
#: Sets that are probed first, those met most often in the short lists.
FIRST_PROBED = 32


def forest(ids: list[int], sizes: list[int], sets: list[np.ndarray], roots: list[int], asks: list[bool], percent: int) -> list[tuple[int, int]]:
    """Links that connect whatever links of the sets that ask connect; ``roots`` are known components.

    Sets are taken in the order of size; a query looks among those before it, and
    leaves a component with the first link into it.
    """
    order = sorted(range(len(ids)), key=lambda i: (asks[i], sizes[i], ids[i]))
    index = Lists([sets[i] for i in order])
    label = np.unique(np.array([roots[i] for i in order]), return_inverse=True)[1]
    m = np.array([sizes[i] for i in order])
    links = []
    for at, i in enumerate(order):
        begin, length = index.of[at]
        need = setjoin.overlap_needed(sizes[i], percent)
        some = length > 0
        if not asks[i] or some.sum() < need:
            continue
        begin, length = begin[some], length[some]
        by_length = np.argsort(length, kind="stable")
        begin, length = begin[by_length], length[by_length]
        cut = len(length) - long_lists(need, int(length[-1]))
        met = index.merged(begin[:cut], length[:cut], at)
        found = np.flatnonzero((met >= need - (len(length) - cut)) & (label[:at] != label[at]))
        found = found[np.argsort(-met[found], kind="stable")]
        for part in (found[:FIRST_PROBED], found[FIRST_PROBED:]):
            part = np.sort(part[label[part] != label[at]])
            if not len(part):
                continue
            least = -(-percent * (sizes[i] + m[part]) // (100 + percent))
            for r in index.probed(part, met[part], least, begin[cut:], length[cut:]).tolist():
                if label[r] != label[at]:
                    links.append((ids[i], ids[order[r]]))
                    label[label == label[at]] = label[r]
    return links


def slice_columns(t):
    """A slice's rows, every sid once: sids, sizes, prefix lengths, token lists, components, who asks."""
    sid = t.column("sid").to_numpy()
    asks = t.column("asks").to_numpy()
    order = np.lexsort((~asks, sid))
    keep = order[np.r_[True, sid[order][1:] != sid[order][:-1]]] if len(order) else order
    tokens = t.column("tokens").take(keep).to_pylist()
    pick = lambda c: t.column(c).to_numpy()[keep].tolist()
    return pick("sid"), pick("n"), pick("plen"), [np.frombuffer(x, np.int64) for x in tokens], pick("comp"), asks[keep].tolist()


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, rounds: int = setjoin.ROUNDS) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    common.small_batches(spark)

    def make(b):
        data, at = words.raw(b.column(1))
        h, start, _ = words.words(data, at)
        tokens, ends = words.sets_of(h, words.owners(at, start), b.num_rows, shingle)
        meta = np.zeros(b.num_rows, setjoin.META)
        meta["id"] = b.column(0).fill_null(0).to_numpy()
        meta["n"] = np.diff(ends)
        d = words.digests(tokens, ends)
        meta["d0"], meta["d1"] = d[:, 0], d[:, 1]
        return meta, tokens, ends

    def measure(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["id", "n", "digest", "sets", "token", "times"]
        for b in batches:
            meta, tokens, _ = make(b)
            full = meta["n"] > 0
            digest = setjoin._binary(np.stack([meta["d0"], meta["d1"]], 1).reshape(-1), np.arange(1, len(meta) + 1) * 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(meta["n"].astype(np.int64)), pc.if_else(pa.array(full), digest, None), *(pa.nulls(len(meta), pa.int64()) for _ in range(3))], names)
            hot, times = setjoin.hot_here(tokens, int(full.sum()))
            extra = [pa.array([int(full.sum())] + [None] * len(hot), pa.int64()), pa.array([None, *hot.tolist()], pa.int64()), pa.array([None, *times.tolist()], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.nulls(1 + len(hot), k) for k in (pa.int64(), pa.int64(), pa.binary())] + extra, names)

    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    measured = common.written(src.mapInArrow(measure, "id long, n long, digest binary, sets long, token long, times long"), "shingles")
    rows = measured.where("n IS NOT NULL").select("id", "n", "digest")
    reported = measured.where("sets IS NOT NULL OR token IS NOT NULL").select("sets", "token", F.col("times").alias("n"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    shared = setjoin.shared_tokens(src.where("id IS NOT NULL AND text IS NOT NULL"), make, total, setjoin.hot_tokens(reported))
    sets = setjoin.classes(setjoin.candidates(shared, percent), numbered=False)
    common.dropped(shared)

    def work(t):
        import pyarrow as pa

        sid, n, _, tokens, comp, asks = slice_columns(t)
        links = forest(sid, n, tokens, comp, asks, percent)
        if links:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    def state_of(found):
        return common.components(found).select(F.col("id").alias("sid"), "component_id")

    # an id with several texts is one vertex: its classes are tied together
    ids = rows.where("id IS NOT NULL AND digest IS NOT NULL")
    first = ids.groupBy("digest").agg(F.min("id").alias("rep"))
    ties = ids.groupBy("id").agg(F.min("digest").alias("d1"), F.max("digest").alias("d2")).where("d1 <> d2").select("id")
    ties = ids.join(ties, "id").select("id", "digest").distinct().join(first, "digest").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = setjoin.join_sets(sets, work, False, percent, "a long, b long", state_of, rounds)
    common.dropped(sets)
    links = ties if links is None else links.union(ties)
    of = first.join(common.components(links).select(F.col("id").alias("rep"), "component_id"), "rep", "left")
    of = of.select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.join(of, "digest", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(common.read_table(spark, sf_dir, "documents", "doc_id", "text"))

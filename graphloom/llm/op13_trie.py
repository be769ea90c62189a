r"""Prefix trie of conversations by distributed MSD radix partitioning.

A conversation is its sequence of turns; every distinct sequence of first d
turns is a node of depth d, its members the conversations that start with it.

1. Turns (role and text) get a number by a dictionary of their SHA-256; texts
   are read once and never shuffled.  Turns are numbered within conversations by
   a sort by range, whose partitions only hand their totals on
   (:func:`running`), so that one conversation may span many tasks.
2. The root's bucket, all conversations, is dealt by the first turn.  A bucket of
   at most ``local_rows`` turns is local: one task takes it whole, many such
   buckets one after the other.  Multikey quicksort divides its members by a
   pivot turn into less, equal and greater; every "equal" part is a node, which
   the recursion (a stack) emits with its subtree's sums.
3. A larger bucket recurses.  Its members are counted by place: up to the first
   place where they differ or one ends, the bucket is a chain of nodes, emitted
   from these counts; there it is dealt by the turn into buckets anew.  A round
   thus treats a common start of any length, copies of long conversations and a
   single huge one included; rounds are as many as branchings with a large
   bucket on both sides of them.
4. Sums over subtrees of chains come from the buckets dealt from their end, the
   last round first.

A bucket is known by its smallest member and its depth, as is a node.  No task
holds more than one local bucket; counts by place and by turn are combined
before they are shuffled.  The hash of the members that end at a node reads
their ids in order as a stream, in one task as a hash must be, but in runs that
range partitions joined before.

Turns are ordered by number (null first), then role, then the SHA-256 of role
and text; null roles and texts are empty; rows without a conversation's id
belong to none and are left out; repeated rows are turns of their own.  An empty
table has no root, so no rows.  Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Turns that a task may take whole.
LOCAL_ROWS = 500_000
#: Ids joined in one run of the members that end at a node.
RUN = 4096
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NONE = hashlib.sha256(b"").hexdigest()


def runs(batches, keys: int):
    """(columns as arrays) of every batch, cut so that rows of equal first ``keys`` columns stay together."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        new = np.zeros(len(cols[0]), bool)
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        new[0] = bool(held) and any(h[-1] != c[0] for h, c in zip(held[-1][:keys], cols[:keys], strict=True))
        cuts = np.flatnonzero(new)
        if len(cuts):
            last = int(cuts[-1])
            whole = [*held, [c[:last] for c in cols]]
            yield [np.concatenate(x) for x in zip(*whole, strict=True)]
            held = [[c[last:] for c in cols]]
        else:
            held.append(cols)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def running(rows: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """``rows`` with (at, total): number within the keys (long columns without nulls), from 0, and sum of ``value`` up to there.

    The table is sorted by range; a key that spans partitions goes on from what
    the partitions before hold of it.  The driver sees one row a partition.
    """
    spark = rows.sparkSession
    names = rows.columns
    ranged = rows.repartitionByRange(common.width(spark), *keys, *order).sortWithinPartitions(*keys, *order)
    at_keys, at_value = [names.index(k) for k in keys], names.index(value)

    def number(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        before, count, total = None, 0, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            held = [b.column(k).to_numpy() for k in at_keys]
            v = b.column(at_value).to_numpy()
            new = np.zeros(n, bool)
            for c in held:
                new[1:] |= c[1:] != c[:-1]
            first = [c[0] for c in held]
            new[0] = before is None or any(x != y for x, y in zip(first, before, strict=True))
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: goes on from the batch before
            sums = np.r_[0, np.cumsum(v)]
            at = np.arange(n) - np.maximum(start, 0) + np.where(start < 0, count, 0)
            totals = sums[1:] - sums[np.maximum(start, 0)] + np.where(start < 0, total, 0)
            before, count, total = [c[-1] for c in held], int(at[-1]) + 1, int(totals[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part)), pa.array(np.arange(row, row + n)), pa.array(at), pa.array(totals)], [*names, "part_", "row_", "at", "total"])
            row += n

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    table = common.written(ranged.mapInArrow(number, f"{schema}, part_ long, row_ long, at long, total long"), "running")
    ends = table.groupBy("part_").agg(F.min_by(F.struct(*keys), "row_").alias("first"), F.max_by(F.struct(*keys), "row_").alias("last"), F.max_by(F.struct("at", "total"), "row_").alias("sums")).orderBy("part_").collect()
    carried, key, count, total = [], None, 0, 0
    for r in ends:  # one a partition
        goes_on = key is not None and tuple(r["first"]) == key
        if goes_on:
            carried.append((r["part_"], *key, count, total))
        whole = goes_on and tuple(r["last"]) == key
        key, count, total = tuple(r["last"]), r["sums"]["at"] + 1 + (count if whole else 0), r["sums"]["total"] + (total if whole else 0)
    schema = ", ".join(["part_ long", *(f"{k} long" for k in keys), "more_at long", "more_total long"])
    out = table.join(F.broadcast(spark.createDataFrame(carried, schema)), ["part_", *keys], "left")
    out = out.select(*names, (F.col("at") + F.coalesce("more_at", F.lit(0))).alias("at"), (F.col("total") + F.coalesce("more_total", F.lit(0))).alias("total"))
    out.kept_at = table.kept_at
    return out


def originals(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, at, turn_id, chars): the turns as they stand, numbered within the conversation, in dictionary code."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), said.alias("said"), F.length(text).cast("long").alias("chars"))
    rows = common.written(rows, "turns")
    codes = common.written(rows.select("said").distinct().withColumn("turn_id", F.monotonically_increasing_id()), "turn-codes")
    coded = common.written(rows.join(codes, "said"), "coded-turns")
    numbered = running(coded, ["conv"], [F.asc_nulls_first("turn"), F.asc("role"), F.asc("said")], "chars")
    out = numbered.select("conv", "at", "turn_id", "chars")
    out.kept_at = numbered.kept_at
    common.dropped(rows, codes, coded)
    return out


def rebuilt(turns: DataFrame, span: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations (conv, len), sequences (conv, pos, turn_id, chars, len)).

    Conversation c begins with the first h = crc32(c) mod ``most`` turns of
    c - c mod ``span`` and goes on with its own after its first h.
    """
    h = F.crc32(F.col("conv").cast("string")) % most
    own = turns.groupBy("conv").agg(F.count("*").alias("own")).withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % span)
    taken = F.least("h", F.coalesce("held", F.lit(0)))
    convs = own.join(own.select(F.col("conv").alias("base"), F.col("own").alias("held")), "base", "left").withColumn("taken", taken)
    convs = common.written(convs.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")), "conversations")
    heads = turns.where((F.col("conv") % span == 0) & (F.col("at") < most)).select(F.col("conv").alias("base"), F.col("at").alias("pos"), "turn_id", "chars")
    begun = convs.join(heads, "base").where("pos < h").select("conv", "pos", "turn_id", "chars", "len")
    rest = turns.where(F.col("at") >= h).join(convs, "conv").select("conv", (F.col("taken") + F.col("at") - F.col("h")).alias("pos"), "turn_id", "chars", "len")
    return convs.select("conv", "len"), common.written(begun.union(rest), "sequences")


def grown(members: list[int], seqs: list[list[int]], chars: list[list[int]], top: int, parent: int | None, out: list[list]) -> None:
    """Appends the nodes of a bucket to the columns ``out``: multikey quicksort over its members, ids ascending.

    ``seqs`` start with the turn of depth ``top``, which all members share.
    """
    at = len(out[0])
    conv, depth, above, size, children, leaves, saved, ends, up = out
    stack = [(list(range(len(members))), 0, -1)]
    while stack:
        group, d, node = stack.pop()
        while group:
            if len(group) > 1:
                pivot = seqs[group[len(group) // 2]][d]
                equal = [m for m in group if seqs[m][d] == pivot]
                if len(equal) < len(group):
                    less, greater = [m for m in group if seqs[m][d] < pivot], [m for m in group if seqs[m][d] > pivot]
                    stack += [(part, d, node) for part in (less, greater) if part]
            else:
                equal = group
            new = len(conv)
            conv.append(members[equal[0]])
            depth.append(top + d)
            above.append(conv[node] if node >= 0 else parent)
            size.append(len(equal))
            children.append(0)
            leaves.append(0)
            saved.append((len(equal) - 1) * chars[equal[0]][d])
            up.append(node)
            if node >= 0:
                children[node] += 1
            d += 1
            ended = [members[m] for m in equal if len(seqs[m]) == d]
            ends.append(hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest() if ended else NONE)
            group = [m for m in equal if len(seqs[m]) > d] if ended else equal
            node = new
    for k in range(len(conv) - 1, at - 1, -1):
        leaves[k] = leaves[k] or 1
        if up[k] >= 0:
            leaves[up[k]] += leaves[k]
            saved[up[k]] += saved[k]


def finished(rows: DataFrame, local_rows: int) -> DataFrame:
    """All nodes of local buckets, with ``is_top`` for the bucket's own."""
    spark = rows.sparkSession
    cols = rows.select("head", "top", "conv", "pos", "turn_id", "chars", "parent")
    dealt = cols.repartition(max(common.width(spark), -(-rows.count() // (2 * local_rows))), "head", "top").sortWithinPartitions("head", "top", "conv", "pos")

    def solve(batches):
        import pyarrow as pa

        common.lean()
        for head, top, conv, _, turn, chars, parent in runs(batches, 2):
            n = len(head)
            new_conv = np.r_[True, (conv[1:] != conv[:-1]) | (head[1:] != head[:-1]) | (top[1:] != top[:-1])]
            starts = np.flatnonzero(new_conv)
            new_bucket = np.r_[True, (head[1:] != head[:-1]) | (top[1:] != top[:-1])][starts]
            bounds = [*np.flatnonzero(new_bucket).tolist(), len(starts)]
            edges = [*starts.tolist(), n]
            turn, chars, ids = turn.tolist(), chars.tolist(), conv[starts].tolist()
            out: list[list] = [[] for _ in range(9)]
            for a, b in zip(bounds, bounds[1:]):
                mine = [(edges[k], edges[k + 1]) for k in range(a, b)]
                grown(ids[a:b], [turn[x:y] for x, y in mine], [chars[x:y] for x, y in mine], int(top[edges[a]]), int(parent[edges[a]]), out)
            for k in range(0, len(out[0]), 50_000):
                part = [c[k : k + 50_000] for c in out]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in part[:7]), pa.array(part[7]), pa.array([u < 0 for u in part[8]])], [*(x.split()[0] for x in NODE.split(", ")), "is_top"])

    return common.written(dealt.mapInArrow(solve, f"{NODE}, is_top boolean"), "trie-nodes")


def hashed_ends(ended: DataFrame) -> DataFrame:
    """(head, depth, ends_sha256) of (head, depth, conv)."""
    spark = ended.sparkSession

    def join(batches):
        import pyarrow as pa

        for b in batches:
            head, depth, conv = (c.to_numpy() for c in b.columns)
            cut = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]) | (depth[1:] != depth[:-1])]) if b.num_rows else []
            for a, e in zip(cut, [*cut[1:], b.num_rows]):
                for k in range(a, e, RUN):
                    ids = conv[k : min(e, k + RUN)]
                    yield pa.RecordBatch.from_arrays([pa.array(head[k : k + 1]), pa.array(depth[k : k + 1]), pa.array(ids[:1]), pa.array([",".join(map(str, ids.tolist()))])], ["head", "depth", "first", "ids"])

    def digest(batches):
        import pyarrow as pa

        key, state = None, None
        give = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], ["head", "depth", "ends_sha256"])
        for b in batches:
            for h, d, _, ids in zip(*(c.to_pylist() for c in b.columns)):
                if (h, d) != key:
                    if key is not None:
                        yield give()
                    key, state = (h, d), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if key is not None:
            yield give()

    cols = ["head", "depth", "conv"]
    joined = ended.select(*cols).repartitionByRange(common.width(spark), *cols).sortWithinPartitions(*cols).mapInArrow(join, "head long, depth long, first long, ids string")
    return joined.repartition(common.width(spark), "head", "depth").sortWithinPartitions("head", "depth", "first").mapInArrow(digest, "head long, depth long, ends_sha256 string")


def below(tops: DataFrame) -> DataFrame:
    """(head, depth, n_children, leaves, below) of the nodes right above ``tops``."""
    return tops.groupBy(F.col("parent_conv_id").alias("head"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))


def chains(places: DataFrame, bounds: DataFrame, ended: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes of the chains of large buckets, with ``is_top``."""
    chain = places.join(F.broadcast(bounds), ["head", "top"]).where("pos < last").withColumn("own", (F.col("n_convs") - 1) * F.col("chars"))
    chain = common.written(chain.select("head", "top", "pos", "own", "n_convs", "last", "parent"), "chains")
    sums = running(chain, ["head", "top"], [F.desc("pos")], "own").withColumn("depth", F.col("pos") + 1)
    more = below(tops).join(hashed_ends(ended), ["head", "depth"], "full").select("head", F.col("depth").alias("last"), "n_children", "leaves", "below", "ends_sha256")
    at_end = F.col("depth") == F.col("last")
    return common.written(
        sums.join(more, ["head", "last"], "left").select(
            F.col("head").alias("conv_id"),
            "depth",
            F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("head")).alias("parent_conv_id"),
            "n_convs",
            F.when(at_end, F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (F.col("total") + F.coalesce("below", F.lit(0))).cast("long").alias("saved_tokens"),
            F.when(at_end, F.coalesce("ends_sha256", F.lit(NONE))).otherwise(NONE).alias("ends_sha256"),
            (F.col("depth") == F.col("top")).alias("is_top"),
        ),
        "trie-chains",
    )


def dealt_anew(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows of large buckets in the buckets dealt by the turn where members differ."""
    open_ = rows.join(F.broadcast(bounds.select("head", "top", "last")), ["head", "top"]).where("pos >= last")
    here = open_.where("pos = last").select("head", "top", "turn_id", "conv")
    heads = here.groupBy("head", "top", "turn_id").agg(F.min("conv").alias("new_head"))
    to = here.join(heads, ["head", "top", "turn_id"]).select("conv", "new_head")
    return open_.join(to, "conv").select(F.col("head").alias("parent"), F.col("new_head").alias("head"), (F.col("last") + 1).alias("top"), "conv", "pos", "turn_id", "chars", "len")


def trie(convs: DataFrame, sequences: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """All nodes of conversations (conv, len) and their turns (conv, pos, turn_id, chars, len)."""
    spark = convs.sparkSession
    whole = convs.agg(F.min("conv").alias("head"), F.count("*").alias("n_convs")).first()
    if not whole["n_convs"]:
        return spark.createDataFrame([], NODE)
    root = whole["head"]
    start = sequences.select(F.lit(root).cast("long").alias("head"), F.lit(0).cast("long").alias("top"), "conv", "pos", "turn_id", "chars", "len")
    rows = common.written(dealt_anew(start, spark.createDataFrame([(root, 0, 0)], "head long, top long, last long")), "buckets")
    done, levels = [], []
    while True:
        large = rows.groupBy("head", "top").count().where(F.col("count") > local_rows).select("head", "top")
        large = common.written(large, "large-buckets")
        if large.isEmpty():
            done.append(finished(rows, local_rows))
            common.dropped(rows, large)
            break
        # at most one large bucket for every local_rows turns: small enough for every task
        done.append(finished(rows.join(F.broadcast(large), ["head", "top"], "left_anti"), local_rows))
        hot = rows.join(F.broadcast(large), ["head", "top"], "left_semi")
        places = hot.groupBy("head", "top", "pos").agg(F.count("*").alias("n"), F.min("turn_id").alias("lo"), F.max("turn_id").alias("hi"), F.min("chars").alias("chars"), F.min("parent").alias("parent"))
        places = common.written(places, "places")
        sizes = places.groupBy("head", "top").agg(F.max("n").alias("n_convs"))
        apart = (F.col("n") < F.col("n_convs")) | (F.col("lo") != F.col("hi"))
        bounds = places.join(sizes, ["head", "top"]).groupBy("head", "top", "n_convs").agg(F.coalesce(F.min(F.when(apart, F.col("pos"))), F.max("pos") + 1).alias("last"))
        bounds = common.written(bounds, "bounds")
        ended = hot.join(F.broadcast(bounds.select("head", "top", "last")), ["head", "top"]).where("pos = last - 1 AND len = last").select("head", F.col("last").alias("depth"), "conv")
        ended = common.written(ended, "ended")
        anew = common.written(dealt_anew(hot, bounds), "buckets")
        levels.append((places, bounds, ended))
        common.dropped(rows, large)
        rows = anew
    tops = done[-1].where("is_top")
    made = [*done]
    for (places, bounds, ended), local in zip(reversed(levels), reversed(done[:-1]), strict=True):
        chain = chains(places, bounds, ended, tops.select("parent_conv_id", "depth", "n_leaves", "saved_tokens"))
        common.dropped(places, bounds, ended)
        made.append(chain)
        tops = local.where("is_top").union(chain.where("is_top"))
    sums = below(tops).select("n_children", "leaves", "below")
    none = hashed_ends(convs.where("len = 0").select(F.lit(root).cast("long").alias("head"), F.lit(0).cast("long").alias("depth"), "conv")).select("ends_sha256")
    top = spark.createDataFrame([(root, whole["n_convs"])], "conv_id long, n_convs long").join(sums, F.lit(True), "left").join(none, F.lit(True), "left")  # one row each
    top = top.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("below", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))
    return reduce(DataFrame.union, [m.drop("is_top") for m in made], top)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    turns = originals(common.read_table(spark, sf_dir, "conversations"))
    convs, sequences = rebuilt(turns)
    common.dropped(turns)
    return trie(convs, sequences)


ORACLE = r"""
with src as (
  select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
own as (
  select c, {'r': role, 't': text} as x,
         row_number() over (partition by c order by turn nulls first, role, sha256(length(role)::varchar || ':' || role || text)) - 1 as at from src),
crc as (
  select c, (list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda d: ascii(d)::bigint)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
          lambda v, z: case when v % 2 = 1 then xor(v // 2, 3988292384::bigint) else v // 2 end))) as v
  from (select distinct c from src)),
conv as (select c, (4294967295 - v) % 6 as h, c - c % 100 as base from crc),
begun as (select conv.c, own.at as pos, own.x from conv join own on own.c = conv.base where own.at < conv.h),
rest as (select conv.c, coalesce(n, 0) + own.at - conv.h as pos, own.x from conv join own on own.c = conv.c left join (select c, count(*) as n from begun group by c) b on b.c = conv.c where own.at >= conv.h),
seq as (select conv.c, coalesce(list(s.x order by s.pos) filter (s.x is not null), []) as xs from conv left join (select * from begun union all select * from rest) s on s.c = conv.c group by conv.c),
path as (select c, unnest(range(len(xs) + 1)) as d, xs from seq),
member as (select c, d, d = len(xs) as ended, list_transform(xs[1:d], lambda x: sha256(length(x.r)::varchar || ':' || x.r || x.t)) as k, case when d > 0 then length(xs[d].t) else 0 end as chars from path),
node as (select d, k, min(c) as conv_id, count(*) as n_convs, any_value(chars) as chars, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ended), '')) as ends_sha256 from member group by d, k),
kid as (select d - 1 as d, k[1:d - 1] as k, count(*) as n from node where d > 0 group by all),
leaf as (select n.d, n.k from node n left join kid on kid.d = n.d and kid.k = n.k where kid.n is null),
leaves as (select a as d, k[1:a] as k, count(*) as n from (select unnest(range(d + 1)) as a, k from leaf) group by all),
saved as (select a as d, k[1:a] as k, sum(s) as s from (select unnest(range(d + 1)) as a, k, (n_convs - 1) * chars as s from node) group by all)
select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(kid.n, 0) as n_children, leaves.n as n_leaves, cast(saved.s as bigint) as saved_tokens, n.ends_sha256
from node n left join node p on p.d = n.d - 1 and p.k = n.k[1:n.d - 1] left join kid on kid.d = n.d and kid.k = n.k
join leaves on leaves.d = n.d and leaves.k = n.k join saved on saved.d = n.d and saved.k = n.k
"""

r"""License scans: an exact containment join of text blocks with license templates.

Words are the runs of ASCII letters and digits and of all characters beyond
ASCII, with A-Z lower-cased.  A template is a sentence that licenses and notices
are known by; the tokens of a template or block are its distinct words.  The
blocks of a text are windows over its words, 2 L words at every L-th word, where
L is the least power of two, 8 at least, that is no smaller than the template:
so every run of as many words as the template has lies in one block, whatever
its lines and comment marks.  A block meets a template if it holds at least
``percent`` of 100 of its tokens.

1. How many documents hold each word of the templates is counted over all
   documents; rarer words come first in the order of tokens.
2. A block that meets a template of n tokens lacks at most n - ceil(n percent /
   100) of them, so it holds one of as many and one more of its rarest: its
   prefix.  Only blocks around such words are looked at.
3. A block with fewer template words than are needed falls to the length filter,
   one whose first shared token leaves too few behind it, in the template or in
   the block, to the positional filter; the overlap of the rest is counted.

All blocks that meet a template are found.  Phrases that stand word for word are
found as places besides.  Templates are a parameter, not data, and are all that
tasks are sent.  Words are told apart by 64 bits of hash.

One row a document: null and empty texts have no words and no findings, repeated
rows and null ids stay as they are, very long texts are read whole, further
columns are left out, an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

#: Percent of a template's tokens that a block must hold.
PERCENT = 80
# Phrases found word for word, and what they say.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Sentences that licenses and their notices are known by; variants of a family, which differ by a word or two, have one label.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "the person who associated CC0 with this work has waived all copyright and related or neighboring rights"),
    ("creative-commons", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("creative-commons", "Licensed under CC BY 4.0"),
    ("reserved", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"),
    ("reserved", "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited"),
    ("warranty", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY"),
)


def hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words.words(data, np.array([0, len(data)]), gap=words.SIGNS)[0]


def least(n: int, percent: int) -> int:
    """Tokens of n that a block must hold."""
    return -(-n * percent // 100)


def half_block(count: int) -> int:
    """Half the words of a block for a template of ``count`` words."""
    return max(8, 1 << (count - 1).bit_length())


def vocabulary(texts: list[str]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(hashes(t) for t in texts)]))


def batches_of_words(batches, known: np.ndarray):
    """(ids, words of every row, row, number in its row and number in ``known`` of every known word) of every batch of (id, text)."""
    common.lean()
    for b in batches:
        if b.num_rows:
            data, offsets = words.raw(b.column(1))
            h, start, _ = words.words(data, offsets, gap=words.SIGNS)
            owner = words.owners(offsets, start)
            sizes = np.bincount(owner, minlength=b.num_rows)
            to = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            mine = np.flatnonzero(known[to] == h) if len(known) else np.zeros(0, np.int64)
            first = np.r_[0, np.cumsum(sizes)[:-1]]
            yield b.column(0), sizes, owner[mine], mine - first[owner[mine]], to[mine]


def frequencies(texts: DataFrame, known: np.ndarray) -> np.ndarray:
    """Documents (id, text) that hold each of the known words."""

    def count(batches):
        import pyarrow as pa

        sums = np.zeros(len(known), np.int64)
        for _, _, row, _, word in batches_of_words(batches, known):
            sums += np.bincount(np.unique(row * len(known) + word) % len(known), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(known))), pa.array(sums)], ["word", "n"])

    out = np.zeros(len(known), np.int64)
    if len(known):
        for r in texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # one row a word of the templates
            out[r["word"]] = r["n"]
    return out


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, places, blocks) a document.

    ``places`` are (label, start) of phrases, in order of their start; ``blocks``
    (label, template, start, end, overlap, tokens) of blocks that meet a template,
    by number of the template and start.  Starts and ends count words from 0.
    """
    common.small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    known = vocabulary([t for _, t in (*templates, *phrases)])
    order = np.empty(len(known), np.int64)  # number of a word among all by (documents, hash)
    order[np.lexsort([known, frequencies(texts, known)])] = np.arange(len(known))
    plans = []
    for number, (label, text) in enumerate(templates):
        h = hashes(text)
        tokens = np.sort(order[np.searchsorted(known, np.unique(h))])
        need = least(len(tokens), percent)
        plans.append((number, label, half_block(len(h)), tokens, need, tokens[: len(tokens) - need + 1]))
    said = [(label, order[np.searchsorted(known, hashes(text))]) for text, label in phrases]
    leading = np.zeros(len(known), bool)
    for p in plans:
        leading[p[5]] = True
    kind = texts.schema[id_col].dataType.simpleString()

    def find(batches):
        import pyarrow as pa

        for ids, sizes, row, at, word in batches_of_words(batches, known):
            rank = order[word]
            places: list[list] = [[] for _ in sizes]
            blocks: list[list] = [[] for _ in sizes]
            for label, its in said:
                here = np.flatnonzero(rank == its[0])
                for j in range(1, len(its)):
                    here = here[here + j < len(rank)]
                    here = here[(rank[here + j] == its[j]) & (row[here + j] == row[here]) & (at[here + j] == at[here] + j)]
                for r, a in zip(row[here].tolist(), at[here].tolist(), strict=True):
                    places[r].append((a, label))
            ends = np.searchsorted(row, np.arange(len(sizes) + 1))
            some = np.flatnonzero(leading[rank])
            for number, label, half, tokens, need, prefix in plans:
                hits = some[np.isin(rank[some], prefix)]
                starts = np.unique(np.concatenate([row[hits] * (1 << 40) + at[hits] // half, (row[hits] * (1 << 40) + at[hits] // half - 1)[at[hits] >= half]]))
                for r, k in zip((starts >> 40).tolist(), (starts & ((1 << 40) - 1)).tolist(), strict=True):
                    lo, hi = np.searchsorted(at[ends[r] : ends[r + 1]], [k * half, (k + 2) * half]) + ends[r]
                    if hi - lo < need:  # length
                        continue
                    held = np.unique(rank[lo:hi])
                    if len(held) < need:
                        continue
                    i = int(np.argmax(np.isin(tokens, held, assume_unique=True)))
                    if 1 + min(len(tokens) - i, len(held) - int(np.searchsorted(held, tokens[i]))) - 1 < need:  # position of the first shared token
                        continue
                    overlap = len(np.intersect1d(held, tokens, assume_unique=True))
                    if overlap >= need:
                        blocks[r].append((label, number, k * half, min((k + 2) * half, int(sizes[r])), overlap, len(tokens)))
            dict_of = lambda names, rows: [[dict(zip(names, x, strict=True)) for x in r] for r in rows]
            placed = pa.array(dict_of(("label", "start"), [[(lab, a) for a, lab in sorted(r)] for r in places]), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())])))
            ints = [(c, pa.int64()) for c in ("template", "start", "end", "overlap", "tokens")]
            met = pa.array(dict_of(("label", "template", "start", "end", "overlap", "tokens"), blocks), pa.list_(pa.struct([("label", pa.string()), *ints])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), placed, met], [id_col, "n_words", "places", "blocks"])

    found = "array<struct<label:string,start:long>>", "array<struct<label:string,template:long,start:long,end:long,overlap:long,tokens:long>>"
    return texts.mapInArrow(find, f"`{id_col}` {kind}, n_words long, places {found[0]}, blocks {found[1]}")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.expr("cast(size(places) as bigint)").alias("n_base"),
        F.expr("get(places, 0).start").alias("first_word"),
        F.expr("get(places, size(places) - 1).start").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(transform(places, p -> p.label))), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(concat(transform(places, p -> p.label), transform(blocks, b -> b.label)))), ',')").alias("labels"),
        F.expr("case when size(places) > 0 then 1D else coalesce(array_max(transform(blocks, b -> b.overlap / b.tokens)), 0D) end").alias("score"),
    )


def _oracle() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    split = lambda s: f"regexp_extract_all(translate({s}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    templates = ", ".join(f"({k}, {text(label)}, {text(t)})" for k, (label, t) in enumerate(TEMPLATES))
    phrases = " union all ".join(
        f"select w0.r, {text(label)} as label, w0.i from words w0 " + " ".join(f"join words w{j} on w{j}.r = w0.r and w{j}.i = w0.i + {j} and w{j}.w = '{w}'" for j, w in enumerate(t.split()) if j) + f" where w0.w = '{t.split()[0]}'"
        for t, label in PHRASES
    )
    return f"""
with docs as (select row_number() over () as r, doc_id, {split("coalesce(text, '')")} as ws from documents),
words as (select r, unnest(ws) as w, unnest(range(len(ws))) as i from docs),
template as (select k, label, {split("t")} as ws from (values {templates}) v(k, label, t)),
need as (select k, label, len(list_distinct(ws)) as n, greatest(8, cast(pow(2, ceil(log2(len(ws)))) as bigint)) as half from template),
token as (select distinct k, unnest(ws) as w from template),
near as (select r, w, half, i // half as b from words, (select distinct half from need) where w in (select w from token)
         union select r, w, half, i // half - 1 from words, (select distinct half from need) where i >= half and w in (select w from token)),
met as (select x.r, need.label, count(*) / need.n::double as part
        from (select distinct r, w, half, b from near) x join token using (w) join need on need.k = token.k and need.half = x.half
        group by x.r, x.b, need.k, need.label, need.n having count(*) * 100 >= {PERCENT} * need.n),
place as ({phrases}),
based as (select r, count(*) as n, min(i) as lo, max(i) as hi, string_agg(distinct label, ',' order by label) as labels from place group by r),
added as (select r, max(part) as part from met group by r),
every as (select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from place union select r, label from met) group by r)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(b.n, 0) as n_base, b.lo as first_word, b.hi as last_word, coalesce(b.labels, '') as base_labels,
       coalesce(e.labels, '') as labels, case when b.n > 0 then 1.0::double else coalesce(a.part, 0.0::double) end as score
from docs d left join based b on d.r = b.r left join added a on d.r = a.r left join every e on d.r = e.r
"""


ORACLE = _oracle()

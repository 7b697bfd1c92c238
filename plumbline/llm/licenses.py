"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words, over line ends and marks, of at most ``|T| / threshold``
words for template T with |T| words. T is contained in block B if ``|T & B| >= threshold * |T|``
over their sets of words. Words are ordered by how many documents hold them, rarest first; then

* prefix filter: B must hold one of T's first ``|T| - need + 1`` words, so only what is within a
  block's length of these places is looked at;
* length filter: there must be ``need`` places of T's words or more;
* positional filter: of the words not rarer than the one at such a place, enough must be near it.

The filters lose no match, so the join is exact for any threshold. Templates are a stated
set of queries; texts are read twice (word counts, then the join) and never move.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import WORD_BYTES, with_columns, words_of

#: Phrases of the base search and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Sentences by which licenses are named or granted, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial International License"),
    ("cc-by", "Creative Commons Attribution 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "either version 3 of the License, or at your option any later version GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.8

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("n_base", T.LongType(), False),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.ArrayType(T.StringType(), False), False),
        T.StructField("labels", T.ArrayType(T.StringType(), False), False),
        T.StructField(
            "blocks",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("start_word", T.LongType()),
                        T.StructField("end_word", T.LongType()),
                        T.StructField("label", T.StringType()),
                        T.StructField("containment", T.DoubleType()),
                    ]
                ),
                False,
            ),
            False,
        ),
        T.StructField("score", T.DoubleType(), False),
    ]
)


def word_counts(docs: DataFrame, words: set[bytes], text: str = "text") -> dict[bytes, int]:
    """In how many documents each of the words (a bounded set) stands, over all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                n.update(words.intersection(words_of(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["w", "n"])

    counted = docs.select(text).mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {bytes(r["w"]): r["n"] for r in counted.collect()}


def find_licenses(
    docs: DataFrame,
    text: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` with the licenses that each text names: the columns of ``FOUND``.

    ``n_base``, ``first_word`` and ``last_word`` are the places of ``PHRASES`` by their first
    word; ``blocks`` are where templates are contained: blocks that begin with a word of the
    template, joined where they overlap, with the largest containment, by label and place
    ``[start_word, end_word)``; ``labels`` has both; ``score`` is the largest containment, 1
    where a phrase stands, 0 where nothing was found.

    A null or empty text has no words, and null places. Columns of ``docs`` with the names of
    results are replaced, others pass. Rows are independent: repeated rows get equal results.
    """
    sets = [(label, frozenset(words_of(t)), len(words_of(t))) for label, t in templates]
    vocabulary = set().union(*(s for _, s, _ in sets)) if sets else set()
    counts = word_counts(docs, vocabulary, text)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    known = []  # label, words by rank in the template, words needed, length of a block
    prefixes: dict[bytes, list[int]] = {}
    for k, (label, words, n) in enumerate(sets):
        order = sorted(words, key=rank.__getitem__)
        need = max(1, math.ceil(threshold * len(order) - 1e-9))
        known.append((label, {w: i for i, w in enumerate(order)}, need, math.ceil(n / threshold)))
        for w in order[: len(order) - need + 1]:
            prefixes.setdefault(w, []).append(k)
    phrases = [(f" {p} ".encode(), label) for p, label in PHRASES.items()]

    def places(k: int, words: list[bytes], at: list[int], first: dict[int, list[int]]) -> Iterator[tuple[int, int, float]]:
        """Where template ``k`` is contained. ``at``: places of words of any template; ``first``: of its prefix words."""
        _, order, need, length = known[k]
        area: list[int] = []
        for p in first[k]:
            low, high = bisect_left(at, p - length + 1), bisect_left(at, p + length)
            near = [q for q in at[low:high] if words[q] in order]
            if len(near) < need:
                continue
            least = order[words[p]]
            if len({words[q] for q in near if order[words[q]] >= least}) >= need:
                area += near
        area = sorted(set(area))
        inside: Counter = Counter()
        end, run = 0, None
        for p in area:
            while end < len(area) and area[end] < p + length:
                inside[words[area[end]]] += 1
                end += 1
            if len(inside) >= need:
                share, stop = len(inside) / len(order), min(p + length, len(words))
                if run is not None and p < run[1]:
                    run = (run[0], stop, max(run[2], share))
                else:
                    if run is not None:
                        yield run
                    run = (p, stop, share)
            inside[words[p]] -= 1
            if not inside[words[p]]:
                del inside[words[p]]
        if run is not None:
            yield run

    def one(t: str | None) -> tuple:
        words = words_of(t)
        starts, base = [], set()
        spaced = b" " + b" ".join(words) + b" "
        for phrase, label in phrases:
            at, before, place = spaced.find(phrase), 0, 0
            while at >= 0:
                place += spaced.count(b" ", before, at)
                before = at
                starts.append(place)
                base.add(label)
                at = spaced.find(phrase, at + 1)
        blocks = []
        if not prefixes.keys().isdisjoint(words):
            at = [i for i, w in enumerate(words) if w in vocabulary]
            first: dict[int, list[int]] = {}
            for i in at:
                for k in prefixes.get(words[i], ()):
                    first.setdefault(k, []).append(i)
            for k in sorted(first):
                blocks += [
                    {"start_word": a, "end_word": b, "label": known[k][0], "containment": c}
                    for a, b, c in places(k, words, at, first)
                ]
        labels = sorted(base | {b["label"] for b in blocks})
        score = max([1.0] * bool(starts) + [b["containment"] for b in blocks], default=0.0)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(base), labels, blocks, score

    def made(batch: pa.RecordBatch) -> list:
        rows = [one(t) for t in batch.column(text).to_pylist()]
        return list(zip(*rows, strict=True)) if rows else [[]] * len(FOUND)

    return with_columns(docs, FOUND, made)

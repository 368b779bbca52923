"""License scans: exact set-similarity join of text blocks with license templates.

The blocks of a text are all runs of consecutive words, over line ends, within a paragraph (lines without a word part paragraphs). A block
meets a template when it holds at least ``THRESHOLD`` of the template's distinct words and is no longer than the template's length by
``THRESHOLD``, so that words strewn over a long line meet nothing. Words of the templates are ordered by how often they occur in
the whole corpus, the rarest first; a block that meets the threshold must hold one of the first ``n - need + 1`` words of the template (prefix
filter), have ``need`` places of its words within the greatest length (length filter), and its rarest common word must leave
``need`` words from it on in the template's order (positional filter). What passes is compared word by word, so the join is exact. It is enough to
look at blocks that begin with a word of the template and have the greatest length: they hold what any other block holds.

A text takes the labels of all templates that a block of it meets, unless for each such block a template of a higher score meets an overlapping
block and holds all of its common words. Beside them stand the base labels: phrases whose words follow one another.

The templates are a fixed list of bounded size, and so are their corpus counts, the only rows that reach the driver.
Null text counts as empty and has no labels (an empty string) and score 0; repeated rows are scanned one by one; very long texts are
scanned whole; of equal scores all labels stay; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.textops import ALNUM, slices, text_hashes, word_hashes, words

THRESHOLD = 0.8

# Phrases that give a label wherever their words follow one another.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Usual lines of public licenses.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("reserved", "All rights reserved."),
    ("reserved", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."),
]


def _template_words() -> np.ndarray:
    return np.unique(np.concatenate(text_hashes([t for _, t in TEMPLATES], ALNUM)))


def word_counts(docs: DataFrame) -> dict[int, int]:
    """How often each word of the templates occurs in the corpus (a row for each word of the fixed templates)."""
    wanted = _template_words()

    def run(batches):
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for s in slices(batch.column("text")):
                starts, _, _ = words(s, ALNUM)
                h = word_hashes(s, starts, ALNUM)
                at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                total += np.bincount(at[wanted[at] == h], minlength=len(wanted))
        yield pa.record_batch([pa.array(wanted.view(np.int64)), pa.array(total)], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


class Templates:
    """Templates over the ordered words of all, as tables: which words each has, their ranks in it, and its limits."""

    def __init__(self, counts: dict[int, int], threshold: float = THRESHOLD):
        texts = text_hashes([t for _, t in TEMPLATES], ALNUM)
        self.words = _template_words()
        number = np.array([counts.get(w, 0) for w in self.words.view(np.int64).tolist()])
        self.rank = np.full((len(texts), len(self.words)), -1)
        self.size, self.need, self.longest = [], [], []
        for k, text in enumerate(texts):
            at = np.unique(np.searchsorted(self.words, text))
            self.rank[k, at[np.lexsort((self.words[at], number[at]))]] = np.arange(len(at))
            self.size.append(len(at))
            self.need.append(max(1, math.ceil(threshold * len(at) - 1e-9)))
            self.longest.append(int(len(text) / threshold + 1e-9))

    def blocks(self, k: int, place: np.ndarray, word: np.ndarray, paragraph: np.ndarray) -> list[tuple[int, int, frozenset]]:
        """Begin, end and common words of all blocks that meet a template, from the places of its words, their numbers and paragraphs."""
        need, n = self.need[k], len(place)
        if n < need:
            return []
        rank = self.rank[k, word]
        begin = np.arange(n)
        end = np.minimum(np.searchsorted(place, place + self.longest[k]), np.searchsorted(paragraph, paragraph, "right"))
        rare = np.concatenate([[0], np.cumsum(rank <= self.size[k] - need)])
        ok = (end - begin >= need) & (rare[end] > rare[begin])
        out = []
        for a, b in zip(begin[ok].tolist(), end[ok].tolist()):
            common = frozenset(word[a:b].tolist())
            if len(common) >= need and int(rank[a:b].min()) <= self.size[k] - need:
                out.append((int(place[a]), int(place[b - 1]) + 1, common))
        return out

    def met(self, place: np.ndarray, word: np.ndarray, paragraph: np.ndarray) -> list[tuple[int, int, int, float]]:
        """Template, begin, end and score of each block of a text that no better template covers."""
        found = []
        for k in range(len(self.size)):
            own = np.flatnonzero(self.rank[k, word] >= 0)
            found += [(a, b, k, common) for a, b, common in self.blocks(k, place[own], word[own], paragraph[own])]
        found.sort(key=lambda x: x[:3])
        score = [len(common) / self.size[k] for _, _, k, common in found]
        reach = max(self.longest)
        out, first = [], 0
        for i, (a, b, k, common) in enumerate(found):
            while found[first][0] <= a - reach:
                first += 1
            covered, j = False, first
            while not covered and j < len(found) and found[j][0] < b:
                _, end, other, theirs = found[j]
                covered = end > a and other != k and score[j] > score[i] and theirs >= common
                j += 1
            if not covered:
                out.append((k, a, b, score[i]))
        return out


def license_scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each document with its base places, labels and the best containment."""
    templates = Templates(word_counts(docs), threshold)
    phrases = dict(zip(PHRASES.values(), text_hashes(list(PHRASES), ALNUM)))

    def run(batches):
        for batch in batches:
            out = []
            for s in slices(batch.column("text")):
                out += _scan(s, templates, phrases)
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )


def _scan(s, templates, phrases) -> list[tuple]:
    starts, _, bounds = words(s, ALNUM)
    h = word_hashes(s, starts, ALNUM)
    rows = len(bounds) - 1
    row_of = np.repeat(np.arange(rows), np.diff(bounds))
    places: dict[int, list[int]] = {}
    base: dict[int, set[str]] = {}
    for label, phrase in phrases.items():
        n = len(phrase)
        if len(h) < n:
            continue
        hit = np.ones(len(h) - n + 1, bool)
        for i, w in enumerate(phrase):
            hit &= h[i : len(h) - n + 1 + i] == w
        at = np.flatnonzero(hit)
        for p in at[row_of[at] == row_of[at + n - 1]].tolist():
            places.setdefault(int(row_of[p]), []).append(p)
            base.setdefault(int(row_of[p]), set()).add(label)
    best: dict[int, float] = {}
    found: dict[int, set[str]] = {}
    at = np.minimum(np.searchsorted(templates.words, h), len(templates.words) - 1)
    place = np.flatnonzero(templates.words[at] == h)
    if len(place):
        line = np.searchsorted(np.union1d(np.flatnonzero(s.data == 0x0A), s.offsets - 1), starts, "left")
        breaks = np.ones(len(h), bool)
        breaks[1:] = (np.diff(line) > 1) | (np.diff(row_of) != 0)
        paragraph, word = np.cumsum(breaks)[place], at[place]
        for k, a, _, score in templates.met(place, word, paragraph):
            row = int(row_of[a])
            best[row] = max(best.get(row, 0.0), score)
            found.setdefault(row, set()).add(TEMPLATES[k][0])
    counts = np.diff(bounds)
    out = []
    for i in range(rows):
        p = places.get(i, [])
        own = base.get(i, set())
        first = int(min(p) - bounds[i]) if p else None
        last = int(max(p) - bounds[i]) if p else None
        score = 1.0 if p else best.get(i, 0.0)
        out.append((int(counts[i]), len(p), first, last, ",".join(sorted(own)), ",".join(sorted(own | found.get(i, set()))), score))
    return out

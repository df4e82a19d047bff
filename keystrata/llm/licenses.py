"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

Base labels come from phrases whose words stand side by side.  The method adds the label of every template of which a
text block holds at least ``num / den`` of the distinct words.  A block is a line, or the lines that as many words in a row
as the template has may touch, so that a wrapped notice is one block; lines without words do not count.

The join is exact.  Template words are ordered by how many blocks of the whole corpus hold them, rarest first.  A block
that reaches the threshold c of a template with n words holds one of its n - c + 1 rarest words (prefix filter), has at
least c words that some template knows (length filter), and, where the first shared prefix word is found, still has
enough words left in both orders (positional filter); the rest is counted.  Templates and their words are a fixed,
small parameter; blocks are joined where they are read, so nothing is shuffled but the word counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Phrases of the contract.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Whole public license notices and their opening sentences, by label.
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at. Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),

    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "This software is released under the MIT License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: frozenset[bytes]
    length: int  # words, repeated ones as well


def words_in(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode(), np.uint8)
    w = C.words_of(data, np.array([0, len(data)]), C.WORD_ALNUM, lower=True)
    raw = w.data.tobytes()
    return [raw[a:b] for a, b in zip(w.starts, w.ends, strict=True)]


def templates_of(texts: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[Template, ...]:
    return tuple(Template(label, frozenset(w), len(w)) for label, w in ((label, words_in(t)) for label, t in texts))


class Vocabulary:
    """Numbers for the words that templates and phrases know."""

    def __init__(self, words: set[bytes]):
        self.words = sorted(words)
        self.number = {w: k for k, w in enumerate(self.words)}
        raw = np.frombuffer(b"".join(self.words), np.uint8)
        ends = np.cumsum([len(w) for w in self.words])
        h = C.span_hashes(raw, ends - np.array([len(w) for w in self.words]), ends)
        self.order = np.argsort(h)
        self.hashes = h[self.order]

    def find(self, words: C.Words) -> np.ndarray:
        """The number of each word, or -1; equal hashes are compared byte by byte."""
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        out = np.where(self.hashes[at] == words.hashes, self.order[at], -1)
        sizes = np.array([len(w) for w in self.words])
        hit = np.flatnonzero(out >= 0)
        good = sizes[out[hit]] == (words.ends - words.starts)[hit]
        for n in range(int(sizes.max())):
            here = np.flatnonzero(good & (sizes[out[hit]] > n))
            expected = np.array([w[n] if len(w) > n else 0 for w in self.words], np.uint8)
            good[here] = words.data[words.starts[hit[here]] + n] == expected[out[hit[here]]]
        out[hit[~good]] = -1
        return out


def needed(template: Template, num: int, den: int) -> int:
    return -(-len(template.words) * num // den)


class Join:
    """Templates in the order of their words' frequencies."""

    def __init__(self, templates: tuple[Template, ...], vocabulary: Vocabulary, counts: dict[int, int], num: int, den: int):
        self.templates = templates
        self.rank = np.empty(len(vocabulary.words), np.int64)
        self.rank[sorted(range(len(vocabulary.words)), key=lambda k: (counts.get(k, 0), k))] = np.arange(len(vocabulary.words))
        self.least = [needed(t, num, den) for t in templates]
        self.sorted = [sorted(int(self.rank[vocabulary.number[w]]) for w in t.words) for t in templates]
        self.index: dict[int, list[tuple[int, int]]] = {}  # rank of a prefix word: (template, place)
        for k, (order, c) in enumerate(zip(self.sorted, self.least, strict=True)):
            for place, r in enumerate(order[: len(order) - c + 1]):
                self.index.setdefault(r, []).append((k, place))
        self.is_prefix = np.zeros(len(vocabulary.words), bool)
        self.is_prefix[list(self.index)] = True

    def matches(self, ranks: list[int]) -> list[tuple[int, float]]:
        """(template, containment) for a block's distinct ranks in order."""
        have, tried, out = set(ranks), set(), []
        for j, r in enumerate(ranks):
            for k, i in self.index.get(r, ()):
                if k in tried:
                    continue
                tried.add(k)  # the first shared prefix word: no smaller one is shared
                c, order = self.least[k], self.sorted[k]
                if len(ranks) < c or 1 + min(len(order) - i - 1, len(ranks) - j - 1) < c:
                    continue
                common = len(have.intersection(order))
                if common >= c:
                    out.append((k, common / len(order)))
        return out


    def wrapped(self, known: np.ndarray, ranks: np.ndarray, begin: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(document, first word, template, containment) of blocks of two or more lines of which both the first and the
        last add words; known words with their ranks, the first word of each line and of each document."""
        hits = np.flatnonzero(self.is_prefix[ranks])
        if not len(hits):
            return
        line = np.searchsorted(begin, known, side="right") - 1
        edge = np.searchsorted(line, np.arange(len(begin) + 1)).tolist()
        doc = (np.searchsorted(first, begin, side="right") - 1).tolist()
        begin, ranks, wanted = begin.tolist(), ranks.tolist(), [set(x) for x in self.sorted]
        tried, done = set(), set()

        def common(k: int, a: int, b: int) -> int:
            return len(wanted[k].intersection(ranks[edge[a] : edge[b + 1]]))

        for p, r in zip(line[hits].tolist(), (ranks[h] for h in hits), strict=True):
            for k, _ in self.index[r]:
                if (p, k) in tried:
                    continue
                tried.add((p, k))
                low = high = p
                room = self.templates[k].length - 2  # words of lines between the first and the last
                while low and doc[low - 1] == doc[p] and begin[p] - begin[low] <= room:
                    low -= 1
                while high + 1 < len(begin) and doc[high + 1] == doc[p] and begin[high + 1] - begin[p + 1] <= room:
                    high += 1
                if common(k, low, high) < self.least[k]:
                    continue
                for i in range(low, p + 1):
                    a, b = i, high
                    while b > p and begin[b] - begin[a + 1] > room:
                        b -= 1
                    n = common(k, a, b)
                    if n < self.least[k]:
                        continue
                    while b > a and common(k, a, b - 1) == n:
                        b -= 1
                    while b > a and common(k, a + 1, b) == n:
                        a += 1
                    if a < b and (a, b, k) not in done:
                        done.add((a, b, k))
                        yield doc[a], begin[a] - int(first[doc[a]]), k, n / len(wanted[k])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, C.Words, np.ndarray]]:
    for batch in batches:
        data, offsets = C.text_buffers(batch.column("text"))
        for a, b in C.doc_runs(offsets):
            own = offsets[a : b + 1] - offsets[a]
            yield batch, a, b, C.words_of(data[offsets[a] : offsets[b]], own, C.WORD_ALNUM, lower=True), own
        C.trim()


def _blocks(words: C.Words, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The block (line of a document) of some words: numbers that differ wherever a line or document ends."""
    breaks = np.sort(np.concatenate([np.flatnonzero(words.data == 10), offsets[1:-1]]))
    return np.searchsorted(breaks, words.starts[at], side="right")


def word_counts(docs: DataFrame, vocabulary: Vocabulary) -> dict[int, int]:
    """In how many blocks of all documents each known word occurs (one number a known word on the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(vocabulary.words), np.int64)
        for _, _, _, words, offsets in _runs(batches):
            number = vocabulary.find(words)
            at = np.flatnonzero(number >= 0)
            pairs = np.unique(_blocks(words, offsets, at) * len(sums) + number[at])
            sums += np.bincount(pairs % len(sums), minlength=len(sums))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word: r.n for r in rows}


def scan(docs: DataFrame, templates: tuple[Template, ...] | None = None, phrases: tuple[tuple[str, str], ...] = PHRASES, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks: one entry for each block and
    template found, with the block's first word, label and containment).

    score: 1 if a phrase is found, else the largest containment found, else 0.  Null and empty texts have no words;
    rows with one id are scanned each; an empty table gives no rows."""
    templates = templates_of() if templates is None else templates
    docs = C.pick(docs, doc_id="doc_id", text="text")
    sought = [(words_in(p), label) for p, label in phrases]
    vocabulary = Vocabulary({w for t in templates for w in t.words} | {w for p, _ in sought for w in p})
    join = Join(templates, vocabulary, word_counts(docs, vocabulary), num, den)
    numbered = [([vocabulary.number[w] for w in p], label) for p, label in sought]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, words, offsets in _runs(batches):
            n = b - a
            number, first = vocabulary.find(words), words.first
            ends = np.append(number, -1)
            doc_end = np.repeat(first[1:], np.diff(first))
            n_base, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: list[set[str]] = [set() for _ in range(n)]
            for phrase, label in numbered:
                at = np.flatnonzero(number == phrase[0])
                at = at[at + len(phrase) <= doc_end[at]]
                for k, w in enumerate(phrase[1:], 1):
                    at = at[ends[at + k] == w]
                doc = np.searchsorted(first, at, side="right") - 1
                place = at - first[doc]
                n_base += np.bincount(doc, minlength=n)
                np.minimum.at(low, doc, place)
                np.maximum.at(high, doc, place)
                for d in np.unique(doc):
                    base[d].add(label)
            labels = [set(s) for s in base]
            score = (n_base > 0).astype(float)
            found: list[list[dict]] = [[] for _ in range(n)]
            known = np.flatnonzero(number >= 0)
            block = _blocks(words, offsets, known)
            ranks = join.rank[number[known]]
            breaks = np.concatenate([[0], np.flatnonzero(words.data == 10), offsets[1:-1]])
            begin = np.unique(np.searchsorted(words.starts, breaks))
            for d, word, k, share in join.wrapped(known, ranks, begin[begin < len(words.starts)], first):
                labels[d].add(templates[k].label)
                score[d] = max(score[d], share)
                found[d].append({"word": word, "label": templates[k].label, "containment": share})
            wanted = np.unique(block[join.is_prefix[ranks]])
            inside = np.isin(block, wanted)
            known, block, ranks = known[inside], block[inside], ranks[inside]
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            for x, y in zip(starts, [*starts[1:], len(block)] if len(starts) else [], strict=True):
                for k, share in join.matches(np.unique(ranks[x:y]).tolist()):
                    d = int(np.searchsorted(first, known[x], side="right") - 1)
                    labels[d].add(templates[k].label)
                    score[d] = max(score[d], share)
                    found[d].append({"word": int(known[x] - first[d]), "label": templates[k].label, "containment": share})
            none = pa.array(n_base == 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, n).cast(pa.int64()),
                    pa.array(np.diff(first)),
                    pa.array(n_base),
                    pa.array(low, mask=none.to_numpy(zero_copy_only=False)),
                    pa.array(high, mask=none.to_numpy(zero_copy_only=False)),
                    pa.array([",".join(sorted(s)) for s in base]),
                    pa.array([",".join(sorted(s)) for s in labels]),
                    pa.array(score),
                    pa.array(found, block_type),
                ],
                names,
            )

    block_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
    ddl = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<word: long, label: string, containment: double>>"
    return docs.mapInArrow(run, ddl)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("blocks")

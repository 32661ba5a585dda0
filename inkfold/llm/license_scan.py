"""License scan: an exact set-similarity join of text blocks with license templates.

Blocks are the windows of 1 to BLOCK_LINES consecutive lines of a document, and for each template the windows of as many
consecutive words as its text has, and as many more as it may lack, wherever lines end; all as sets of words. Of overlapping
word windows the one with the most words in common is told, if it goes over more than BLOCK_LINES lines. A block meets a template when it
holds at least THRESHOLD of the template's distinct words. Template words are ordered from the globally rarest (by the
number of documents that hold them, counted over the whole corpus) to the most frequent. Then, with `need` the least overlap:
a block must hold one of a template's |T| - need + 1 first words (prefix filter), have at least `need` words of the templates'
vocabulary (length filter), and from its first common word on both sides must have enough words left (positional filter).
What passes is counted exactly, so every block that meets the threshold is found and no other.

Base phrases are looked up at word positions. A document's labels are those of its base phrases and, for each block, of the
met template with the most words in common (ties: the largest share); if templates of several labels tie, the label is
`other`. The score is the largest share found, 1 for a base phrase, else 0.

Defined results: null text is empty (no words, no labels); first_word and last_word are null without a base phrase; repeated
rows each get a row; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = Fraction(8, 10)
BLOCK_LINES = 2
#: Phrase -> label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: License names as they stand in notices, by label, with the version words that may follow.
NAMES = {
    "mit": [("mit license", "")],
    "apache": [("apache license", ""), ("apache license", "version 2 0")],
    "gpl": [("gnu general public license", ""), ("gnu general public license", "version 2"), ("gnu general public license", "version 3")],
    "lgpl": [("gnu lesser general public license", ""), ("gnu lesser general public license", "version 3")],
    "agpl": [("gnu affero general public license", ""), ("gnu affero general public license", "version 3")],
    "bsd": [("bsd license", ""), ("bsd 2 clause license", ""), ("bsd 3 clause license", "")],
    "mpl": [("mozilla public license", ""), ("mozilla public license", "version 2 0")],
    "isc": [("isc license", "")],
    "unlicense": [("unlicense", "")],
}
NOTICES = ["released under the {}", "licensed under the {}", "this work is licensed under the {}", "distributed under the terms of the {}"]
#: Creative Commons variants: label -> words.
COMMONS = {"cc-by": "cc by", "cc-by-sa": "cc by sa", "cc-by-nc": "cc by nc", "cc-by-nd": "cc by nd", "cc-by-nc-sa": "cc by nc sa", "cc-by-nc-nd": "cc by nc nd"}
COMMONS_NOTICES = ["licensed under {} 4 0", "licensed under {} 3 0", "this work is licensed under {} 4 0"]

#: Bodies, by label: what stands in a full text or file header whether the license is named or not.
BODIES = {
    "mit": [
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject
        to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the software"""
    ],
    "isc": [
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
        that the above copyright notice and this permission notice appear in all copies"""
    ],
    "bsd": [
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following
        disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
        disclaimer in the documentation and or other materials provided with the distribution"""
    ],
    "apache": [
        """you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org
        licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed
        on an as is basis without warranties or conditions of any kind either express or implied""",
        """subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive
        no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform
        sublicense and distribute the work and such derivative works in source or object form""",
    ],
    "unlicense": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"],
}

_KEEP = bytes(b if chr(b).isalnum() or b >= 0x80 else (10 if b == 10 else 32) for b in range(128)) + bytes(range(128, 256))

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,template:int,first_line:int,lines:int,share:double>>"


class Words(frozenset):
    """The distinct words of a template's text, and how many words the text has."""

    length = 0

    @classmethod
    def of(cls, text: str) -> Words:
        split = text.encode().split()
        out = cls(split)
        out.length = len(split)
        return out


def templates() -> list[tuple[str, frozenset[bytes]]]:
    out = [(label, f"{n.format(name)} {version}") for label, names in NAMES.items() for name, version in names for n in NOTICES]
    out += [(label, n.format(name)) for label, name in COMMONS.items() for n in COMMONS_NOTICES]
    out += [(label, text) for label, texts in BODIES.items() for text in texts]
    return [(label, Words.of(text)) for label, text in out]


def cleaned(text: bytes | None) -> bytes:
    """A-Z lowered, every ASCII character but letters, digits and \\n a space."""
    return (text or b"").lower().translate(_KEEP)


class Matcher:
    """The templates with their words in global order, and an index of their prefixes."""

    def __init__(self, found: list[tuple[str, frozenset[bytes]]], frequency: dict[bytes, int], threshold: Fraction = THRESHOLD):
        self.rank = {w: k for k, w in enumerate(sorted({w for _, t in found for w in t}, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates = [(label, sorted(t, key=self.rank.__getitem__), math.ceil(threshold * len(t))) for label, t in found]
        self.sets = [t for _, t in found]
        self.spans = [getattr(t, "length", len(t)) + len(t) - need for (_, t), (_, _, need) in zip(found, self.templates, strict=True)]
        self.index: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, t, need) in enumerate(self.templates):
            for at, w in enumerate(t[: len(t) - need + 1]):
                self.index[w].append((k, at))
        self.vocabulary = self.rank.keys()
        self.prefixes = frozenset(self.index)

    def met(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(template, words in common) of every template that this block meets."""
        block = sorted(self.rank[w] for w in set(words) & self.vocabulary)
        names = sorted(set(words) & self.vocabulary, key=self.rank.__getitem__)
        seen: set[int] = set()
        out = []
        held = set(names)
        for at, w in enumerate(names):
            for k, there in self.index.get(w, ()):
                if k in seen:
                    continue
                seen.add(k)
                _, t, need = self.templates[k]
                if len(block) < need or 1 + min(len(t) - there - 1, len(names) - at - 1) < need:
                    continue
                if (common := sum(x in held for x in t)) >= need:
                    out.append((k, common))
        return out


    def windows(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(template, words in common, first word, last word) of word windows that meet a template, one of those that overlap."""
        present = self.vocabulary & set(words)
        places = None
        out = []
        for k in sorted({k for w in present & self.prefixes for k, _ in self.index[w]}):
            own, need, span = self.sets[k], self.templates[k][2], self.spans[k]
            if len(own & present) < need:
                continue
            if places is None:
                places = [(i, w) for i, w in enumerate(words) if w in present]
            held: deque[tuple[int, bytes]] = deque()
            count: Counter = Counter()
            best: tuple[int, int, int, int] | None = None
            for i, w in places:
                if w not in own:
                    continue
                held.append((i, w))
                count[w] += 1
                while i - held[0][0] >= span or count[held[0][1]] > 1:
                    _, x = held.popleft()
                    count[x] -= 1
                    if not count[x]:
                        del count[x]
                if best and held[0][0] > best[3]:
                    out.append(best)
                    best = None
                if len(count) >= need and (best is None or len(count) > best[1]):
                    best = (k, len(count), held[0][0], i)
            if best:
                out.append(best)
        return out


def _scan(text: bytes | None, matcher: Matcher, phrases: list[tuple[list[bytes], str]], starts: frozenset[bytes]) -> tuple:
    clean = cleaned(text)
    words = clean.split()
    places, base, labels, blocks, score = [], set(), set(), [], 0.0
    if not starts.isdisjoint(words):
        for phrase, label in phrases:
            first, n, at = phrase[0], len(phrase), -1
            for _ in range(words.count(first)):
                at = words.index(first, at + 1)
                if words[at : at + n] == phrase:
                    places.append(at)
                    base.add(label)
                    score = 1.0
    if not matcher.prefixes.isdisjoint(words):
        lines = [x.split() for x in clean.split(b"\n")]
        hit = [not matcher.prefixes.isdisjoint(x) for x in lines]
        for at in range(len(lines)):
            for n in range(1, BLOCK_LINES + 1):
                if at + n > len(lines) or not any(hit[at : at + n]):
                    continue
                met = matcher.met([w for x in lines[at : at + n] for w in x])
                if not met:
                    continue
                of = lambda m: m[1] / len(matcher.templates[m[0]][1])
                blocks += [(matcher.templates[k][0], k, at, n, of((k, c))) for k, c in met]
                best = max((c, of((k, c))) for k, c in met)
                top = {matcher.templates[k][0] for k, c in met if (c, of((k, c))) == best}
                labels.add(top.pop() if len(top) == 1 else "other")
                score = max(score, max(map(of, met)))
        ends = list(accumulate(map(len, lines)))
        line = lambda i: bisect_right(ends, i)
        rank = lambda m: (m[1], m[1] / len(matcher.templates[m[0]][1]))
        wrapped = [m for m in matcher.windows(words) if line(m[3]) - line(m[2]) >= BLOCK_LINES]
        blocks += [(matcher.templates[m[0]][0], m[0], line(m[2]), line(m[3]) - line(m[2]) + 1, rank(m)[1]) for m in wrapped]
        told: list[tuple] = []
        for m in sorted(wrapped, key=rank, reverse=True):
            if not any(x[2] <= m[3] and m[2] <= x[3] for x in told):
                ties = [x for x in wrapped if rank(x) == rank(m) and x[2] <= m[3] and m[2] <= x[3]]
                told += ties
                top = {matcher.templates[x[0]][0] for x in ties}
                labels.add(top.pop() if len(top) == 1 else "other")
            score = max(score, rank(m)[1])
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score, blocks)


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How many documents hold each template word, over all documents; a number for each template word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for text in b.column(0).cast(pa.binary()).to_pylist():
                found.update(vocabulary.intersection(cleaned(text).split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["w", "n"])

    return {bytes(r.w): r.n for r in docs.select("text").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}


def license_scan(docs: DataFrame, found: list[tuple[str, frozenset[bytes]]] | None = None, threshold: Fraction = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks: a row a document."""
    found = found or templates()
    frequency = document_frequencies(docs, frozenset(w for _, t in found for w in t))
    phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]
    starts = frozenset(p[0] for p, _ in phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(found, frequency, threshold)
        kind = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_line", pa.int32()), ("lines", pa.int32()), ("share", pa.float64())]))
        for b in batches:
            rows = [_scan(t, matcher, phrases, starts) for t in b.column(1).cast(pa.binary()).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            blocks = [[dict(zip(("label", "template", "first_line", "lines", "share"), x, strict=True)) for x in r] for r in cols[7]]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=False)], pa.array(blocks, kind)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)

"""Benchmark decontamination by pigeonhole edit matching over words.

Words are maximal runs of ASCII letters and digits and of non-ASCII characters, A-Z lowered, so case and punctuation don't
matter; a character of a script that is written without spaces (Chinese, Japanese, Thai, Lao, Khmer, Burmese) is a word. An item of m words matches a place of a document at up to k = m * EDIT_PERCENT // 100 word edits. It is split into
k + 1 pieces of nearly equal length; a place within k edits holds at least one of them unchanged, so exact piece hits lose
nothing. Pieces are found by their longest word, then compared whole. Each hit is verified with Myers' bit-parallel edit
distance (one bit a pattern word) over the window that the item can cover there; the reverse run gives the start.

Items are taken from the driver's side in blocks of ITEM_BLOCK items and ITEM_BYTES of text at most, each tried against all
documents, so what the driver and a task hold is bounded whatever the benchmark's size; every further block is another pass.

Defined results: null texts and items have no words, and such items match nothing; items under MIN_ITEM_WORDS words match the
documents that consist of the same words alone (ordinary prose would hold them);
of several places of one item in a document the one with the fewest edits, then the first, is given; repeated items or
documents each give their own rows. Empty tables give no rows, and then all documents are clean.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDIT_PERCENT = 20
MIN_ITEM_WORDS = 5
ITEM_BLOCK, ITEM_BYTES = 20_000, 32_000_000
HIT_SCHEMA = "doc_id long, item_id long, distance int, first_word long, last_word long"

_KEEP = bytes(b if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


#: Characters of scripts without spaces, in UTF-8: Thai and Lao, Burmese, Khmer, kana, Chinese characters.
_UNSPACED = re.compile(rb"(\xe0[\xb8-\xbb].|\xe1[\x80-\x82\x9e\x9f].|\xe3[\x81-\x83\x90-\xbf].|[\xe4-\xe9]..|\xef[\xa4-\xab].)", re.DOTALL)


def split_words(text: bytes | None) -> list[bytes]:
    return _UNSPACED.sub(rb" \1 ", (text or b"").lower().translate(_KEEP)).split()


class Pattern:
    """An item for Myers' algorithm: bit i stands for word i."""

    def __init__(self, words: list[bytes]):
        self.m = len(words)
        self.bits: dict[bytes, int] = defaultdict(int)
        self.back: dict[bytes, int] = defaultdict(int)
        for i, w in enumerate(words):
            self.bits[w] |= 1 << i
            self.back[w] |= 1 << (self.m - 1 - i)
        self.bits, self.back = dict(self.bits), dict(self.back)

    def _best(self, text: list[bytes], bits: dict[bytes, int], anchored: bool) -> tuple[int, int]:
        """Least distance of the pattern to a stretch of text that ends at a word (that also begins at the first, if anchored), and the first such end."""
        full, high = (1 << self.m) - 1, 1 << (self.m - 1)
        plus, minus, score = full, 0, self.m
        best, end = score, 0
        for j, w in enumerate(text, 1):
            eq = bits.get(w, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | (~(xh | plus) & full)
            mh = plus & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
            ph = ((ph << 1) | anchored) & full
            mh = (mh << 1) & full
            plus = mh | (~(xv | ph) & full)
            minus = ph & xv
            if score < best:
                best, end = score, j
        return best, end

    def found(self, text: list[bytes], most: int) -> tuple[int, int, int] | None:
        """(distance, first, last) of the best place in text within `most` edits."""
        best, end = self._best(text, self.bits, False)
        if best > most or not end:
            return None
        _, back = self._best(text[end - 1 :: -1], self.back, True)
        return best, end - max(back, 1), end - 1


class Items:
    """A block of items, and pieces by their longest word. An item's pattern is made when one of its pieces is first hit."""

    def __init__(self, items: list[tuple[int, bytes | None]], percent: int = EDIT_PERCENT):
        self.items, self.pieces, self.short = [], defaultdict(list), defaultdict(list)
        self.patterns: dict[int, Pattern] = {}
        for item_id, text in items:
            words = split_words(text)
            m = len(words)
            if not m:
                continue
            k = m * percent // 100
            at = len(self.items)
            self.items.append((item_id, words, k))
            if m < MIN_ITEM_WORDS:
                self.short[tuple(words)].append(at)
                continue
            for p in range(k + 1):
                a, b = p * m // (k + 1), (p + 1) * m // (k + 1)
                anchor = max(range(a, b), key=lambda i: len(words[i]))
                self.pieces[words[anchor]].append((at, a, anchor - a, words[a:b]))

    def hits(self, words: list[bytes]) -> dict[int, tuple[int, int, int]]:
        """item -> (distance, first, last) for a document's words."""
        out: dict[int, tuple[int, int, int]] = {}
        pieces = self.pieces
        seen: set[tuple[int, int]] = set()
        if len(words) < MIN_ITEM_WORDS:
            out |= {at: (0, 0, len(words) - 1) for at in self.short.get(tuple(words), ())}
        for i in [i for i, w in enumerate(words) if w in pieces]:
            for at, offset, inside, piece in pieces[words[i]]:
                start = i - inside
                if start < 0 or words[start : start + len(piece)] != piece or (at, start - offset) in seen:
                    continue
                seen.add((at, start - offset))
                _, own, k = self.items[at]
                pattern = self.patterns.get(at) or self.patterns.setdefault(at, Pattern(own))
                left = max(0, start - offset - k)
                place = pattern.found(words[left : start - offset + pattern.m + k], k)
                if place and (at not in out or (place[0], place[1] + left) < out[at][:2]):
                    out[at] = (place[0], place[1] + left, place[2] + left)
        return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, bytes | None]]]:
    block: list[tuple[int, bytes | None]] = []
    size = 0
    for r in items.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).orderBy("item_id", "text").toLocalIterator():
        block.append((r[0], None if r[1] is None else bytes(r[1])))
        size += len(block[-1][1] or b"")
        if len(block) == ITEM_BLOCK or size >= ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, percent: int = EDIT_PERCENT) -> DataFrame:
    """doc_id, item_id, distance, first_word, last_word: a row for each document and item that it holds."""
    src = docs.select(F.col("doc_id").cast("long"), "text")
    out = docs.sparkSession.createDataFrame([], HIT_SCHEMA)
    for n, block in enumerate(_blocks(items)):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # ITEM_BLOCK items and ITEM_BYTES at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found = Items(shared.value, percent)
            for b in batches:
                rows = [(doc, found.items[at][0], *place) for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True) for at, place in found.hits(split_words(text)).items()]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "distance", "first_word", "last_word"])

        more = src.mapInArrow(run, HIT_SCHEMA)
        out = more if not n else out.unionAll(more)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, percent: int = EDIT_PERCENT) -> DataFrame:
    """The rows of docs, with its columns, that hold no item."""
    at = docs.columns.index("text")
    for block in _blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found = Items(shared.value, percent)
            for b in batches:
                clean = [not found.hits(split_words(t)) for t in b.column(at).cast(pa.binary()).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

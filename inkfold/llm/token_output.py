"""Token ids of whole texts, written as range-coded frames in ascending doc_id order and read back.

Documents are dealt by ranges of doc_id and sorted within each range; a task tokenizes its documents, appends the end id and
writes frames (rangecoder.py) of whole documents, about FRAME_IDS ids each, as rows (part, frame, n_docs, n_ids, data) of a
Parquet table in the shared folder, which every executor and later reader sees. A frame is decoded by itself; ids of the
frames before it are summed from their row counts, by part and then over parts.

Words between ASCII spaces are tokenized once a task and remembered, CACHE_WORDS at most: the tokenizer drops white space,
never joins across it, and its normal form composes nothing with an ASCII space, so a text's ids are its words' ids in order.
A tokenizer for which that doesn't hold is to be used with by_word=False. Where the tokenizer's rules are those of _RULES, a word of
printable ASCII is cut into pieces by the same rules here and only its pieces go through the model, without the normalizer's and
splitter's regular expressions, which cost most of a word's time; its ids are the pieces' ids in order.

Defined results: null text is an empty one and holds the end id only; null doc_ids come first; equal doc_ids follow their
text; repeated rows each get a row. An empty table gives an empty table. A damaged frame raises FrameError.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, written
from .packed import pieces, trimmed
from .rangecoder import decode_frame, encode_frame

END_ID = 2
FRAME_IDS = 4_800_000
CACHE_WORDS = 250_000
PIECE_BYTES = 1_500_000
FRAME_SCHEMA = "part int, frame int, n_docs long, n_ids long, data binary"

#: Rules under which an ASCII word's pieces are those of _PIECE over its lower case. Added tokens hold a <, contractions a '.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
_PIECE = re.compile("[a-z]+|[0-9]|[^a-z0-9]+")
_PLAIN = re.compile(rb"[!-&(-;=-~]+")  # printable ASCII but ' and <


class WordTokens:
    """Ids of texts by way of their words."""

    def __init__(self, path: str, by_word: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor runs a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = by_word
        told = json.loads(self.tokenizer.to_str())
        plain = all(told.get(k) == v for k, v in _RULES.items()) and all("<" in t["content"] for t in told["added_tokens"])
        self.model = self.tokenizer.model if plain else None
        self.pieces: dict[str, list[int]] = {}
        self._clear()

    def _clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.ids, self.start = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        self.flat, self.first = self.ids[0], self.start[0]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> list[int]:
        if len(self.pieces) >= CACHE_WORDS:
            self.pieces.clear()
        found = self.pieces[piece] = [t.id for t in self.model.tokenize(piece)]
        return found

    def _words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of words."""
        if self.model is None:
            return self._encode([w.decode() for w in words])
        out: list = [None] * len(words)
        others = []
        for k, w in enumerate(words):
            if _PLAIN.fullmatch(w):
                low = w.decode().lower()
                if low.isalpha():
                    out[k] = self.pieces.get(low) or self._piece(low)
                else:
                    out[k] = [i for p in _PIECE.findall(low) for i in self.pieces.get(p) or self._piece(p)]
            else:
                others.append(k)
        if others:
            for k, ids in zip(others, self._encode([words[k].decode() for k in others]), strict=True):
                out[k] = ids
        return out

    def __call__(self, texts: list[bytes | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(lengths with the end id, ids) of texts."""
        if not self.by_word:
            found = [[*x, end] for x in self._encode([(t or b"").decode() for t in texts])]
            return np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.int64)
        split = [(t or b"").split() for t in texts]
        if len(self.at) > CACHE_WORDS:
            self._clear()
        at = self.at
        new = [w for w in dict.fromkeys(w for ws in split for w in ws) if w not in at]
        if new:
            for k in range(0, len(new), 4_000):
                part = new[k : k + 4_000]
                got = self._words(part)
                base = len(at)
                at.update(zip(part, range(base, base + len(part)), strict=True))
                self.ids.append(np.fromiter((i for x in got for i in x), np.int32))
                self.start.append(self.start[-1][-1] + np.cumsum([len(x) for x in got]))
            self.ids, self.start = [np.concatenate(self.ids)], [np.concatenate(self.start)]
            self.flat, self.first = self.ids[0], self.start[0]
        counts = np.array([len(ws) for ws in split], np.int64)
        which = np.fromiter((at[w] for ws in split for w in ws), np.int64, int(counts.sum()))
        size = self.first[which + 1] - self.first[which]
        ends = np.cumsum(size)
        bounds = np.r_[0, ends][np.cumsum(counts)]
        lengths = np.diff(np.r_[0, bounds])
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[which] - (ends - size), size)
        ids = np.insert(self.flat[take].astype(np.int64), bounds, end)
        return lengths + 1, ids


def write_frames(docs: DataFrame, path: str, end: int = END_ID, by_word: bool = True) -> DataFrame:
    """The written table of frames of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tokens, frame = TaskContext.get().partitionId(), WordTokens(path, by_word), 0
        kept: list[tuple[list, np.ndarray, np.ndarray]] = []

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal frame
            if kept:
                ids = np.concatenate([x[2] for x in kept])
                doc_ids = [d for x in kept for d in x[0]]
                data = encode_frame(doc_ids, np.concatenate([x[1] for x in kept]), ids)
                cols = [pa.array([part], pa.int32()), pa.array([frame], pa.int32()), pa.array([len(doc_ids)]), pa.array([len(ids)]), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "frame", "n_docs", "n_ids", "data"])
                frame += 1
                kept.clear()

        held = 0
        for p in pieces(batches, 1, PIECE_BYTES):
            lengths, ids = tokens(p.column(1).cast(pa.binary()).to_pylist(), end)
            kept.append((p.column(0).to_pylist(), lengths, ids.astype(np.int32)))
            held += len(ids)
            if held >= FRAME_IDS:
                yield from told()
                held = 0
        yield from told()
        del tokens
        trimmed()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(src.mapInArrow(run, FRAME_SCHEMA), "frames")


def read_documents(frames: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from its frame, in order of start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, frame, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                doc_ids, lengths, ids = decode_frame(data.as_buffer().to_pybytes())
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(np.full(len(doc_ids), (part << 32) | frame), pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "_frame", "_start", "n_tokens", "ids_crc32"])
        trimmed()

    rows = written(frames.select("part", "frame", "data").mapInArrow(run, "doc_id long, _frame long, _start long, n_tokens long, ids_crc32 long"), "decoded")
    slim = frames.select("part", "frame", "n_ids")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = slim.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("_p", before(Window.orderBy("part"), "n")).drop("n")  # a row a part
    slim = slim.withColumn("_f", before(Window.partitionBy("part").orderBy("frame"), "n_ids")).join(parts, "part")
    starts = written(slim.select(F.shiftleft(F.col("part").cast("long"), 32).bitwiseOR(F.col("frame").cast("long")).alias("_frame"), (F.col("_p") + F.col("_f")).alias("_base")), "starts")
    out = join_small(rows, starts, "_frame", F.col("doc_id"))
    return out.select("doc_id", (F.col("_base") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32").orderBy("start")


def token_output(docs: DataFrame, path: str | None = None, end: int = END_ID) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: a row a document, read back from the frames."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return read_documents(write_frames(docs, path, end))

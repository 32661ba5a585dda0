"""Substring dedup: repeated spans of WINDOW words or more, by compaction of the corpus's De Bruijn graph.

The graph's edges are the k-mers of WINDOW words, its nodes what consecutive k-mers share.

1. Anchors. The least of the hashed ANCHOR-mers in a k-mer is its anchor; equal k-mers have equal anchors. Anchors are counted
   over the corpus, about one for every seven words. A document keeps those that stand in several places, and only k-mers with
   such an anchor can be repeated.
2. Edges. These k-mers are counted over the corpus, with whether all their places follow, and are followed by, the same word.
3. Paths. Where a k-mer and the next are repeated equally often, the first has one successor and the second one predecessor,
   the node between them is nonbranching, and they belong to one path. Documents cut their repeated stretches at all other
   nodes: each piece is a whole nonbranching path, one row with its source coordinates, however long it is.
4. Joins. Paths are grouped by a 128-bit hash of all their words, the first source (doc_id, then start) owns each, and a join
   back to the sources marks all others. This hash verifies the span, the words themselves do not move: 64-bit collisions of
   k-mers before only cost, and among 10^13 paths the chance that any two of 128 bits collide is about 1 in 10^13.
5. Words of k-mers on marked paths are removed.

Documents without a repeated anchor are done in step 2 and carry no text further. All exchanges are packed (packed.py): a
block of documents sends a value once, however many of its documents hold it, and path rows are counted before they move.

Defined results: null text has no words; texts under WINDOW words lose none; kept_sha256 is that of the kept words joined by
one space. Rows equal in doc_id and text are one document and get equal rows; unequal texts with one doc_id follow the hash of
their text; a null doc_id comes last. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import pickle
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written
from .packed import WordHash, bucket_edges, buckets_for, by_block, dealt, from_planes, pieces, planes, rolling, sliding, trimmed

WINDOW = 20
ANCHOR = 8
_MANY = np.uint32(0xFFFFFFFF)
_ONE, _TWO = np.uint64(1), np.uint64(2)
_EDGE_OF_TEXT = np.uint32(0)


class _Words:
    """The words of several texts and where k-mers may begin."""

    def __init__(self, texts: list[bytes | None], hashes: WordHash, window: int, anchor: int):
        self.split = [(t or b"").split() for t in texts]
        self.size = np.array([len(w) for w in self.split], np.int64)
        self.first = np.r_[0, np.cumsum(self.size)]
        self.h = np.concatenate([hashes.of(w) for w in self.split]) if len(self.split) else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(self.split)), self.size)
        left = self.first[1:][self.doc] - np.arange(len(self.h)) if len(self.h) else np.zeros(0, np.int64)
        self.starts = np.flatnonzero(left >= window)
        self.window, self.anchor = window, anchor

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor of each k-mer at `starts`, positions chosen as anchors, their values)."""
        if not len(self.starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        span = self.window - self.anchor + 1
        m = np.maximum(rolling(self.h, self.anchor), np.uint64(1))
        low = sliding(m, span)
        valid = np.zeros(len(m) + span - 1, np.uint64)  # by k-mer start, `span - 1` zeros in front
        valid[self.starts + span - 1] = low[self.starts]
        chosen = np.flatnonzero(sliding(valid, span, least=False) == m)
        return low[self.starts], chosen, m[chosen]


def _refs(b: pa.RecordBatch, at: int) -> np.ndarray:
    return b.column(at).to_numpy(zero_copy_only=False).view(np.uint64)


def _anchor_rows(src: DataFrame, n: int, window: int, anchor: int) -> DataFrame:
    """ref, data: for documents with repeated anchors, the values as bytes, one or more rows a document."""

    def grouped(refs: np.ndarray, values: np.ndarray) -> tuple[list[int], list[bytes]]:
        if not len(refs):
            return [], []
        order = np.argsort(refs, kind="stable")
        refs, values = refs[order], values[order]
        at = np.flatnonzero(np.r_[True, refs[1:] != refs[:-1]])
        ends = np.r_[at[1:], len(refs)].astype(np.int64)
        return refs[at].view(np.int64).tolist(), [values[s:e].tobytes() for s, e in zip(at.tolist(), ends.tolist(), strict=True)]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            found_v, found_r = [], []
            for p in pieces(iter([b]), 1):
                w = _Words(p.column(1).cast(pa.binary()).to_pylist(), hashes, window, anchor)
                _, at, values = w.anchors()
                found_v.append(values)
                found_r.append(_refs(p, 0)[w.doc[at]])
            v, r = np.concatenate(found_v or [np.zeros(0, np.uint64)]), np.concatenate(found_r or [np.zeros(0, np.uint64)])
            order = np.argsort(v, kind="stable")
            v, r = v[order], r[order]
            at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
            count = np.diff(np.r_[at, len(v)])
            many = np.repeat(count > 1, count)
            refs, data = grouped(r[many], v[many])  # known here: no need to ask
            refs = [*refs]
            bucket = [x % n for x in refs]
            kinds = [1] * len(refs)
            value, owner, known = v[at], r[at], (count > 1).astype(np.uint8)
            edges = bucket_edges(value, n)
            for k in np.flatnonzero(np.diff(edges)).tolist():
                s, e = edges[k], edges[k + 1]
                refs.append(0)
                bucket.append(k)
                kinds.append(0)
                data.append(value[s:e].tobytes() + owner[s:e].tobytes() + known[s:e].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kinds, pa.int32()), pa.array(refs, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "kind", "ref", "data"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vs, rs, ks = [], [], []
        for b in batches:
            kind = b.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(kind == 1)) for x in (b.column(2), b.column(3))], names=["ref", "data"])
            for data in b.column(3).filter(pa.array(kind == 0)):
                raw = data.as_buffer()
                m = len(raw) // 17
                vs.append(np.frombuffer(raw, np.uint64, m))
                rs.append(np.frombuffer(raw, np.uint64, m, 8 * m))
                ks.append(np.frombuffer(raw, np.uint8, m, 16 * m))
        if vs:
            v, r, k = np.concatenate(vs), np.concatenate(rs), np.concatenate(ks)
            order = np.argsort(v, kind="stable")
            v, r, k = v[order], r[order], k[order]
            at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            count = np.diff(np.r_[at, len(v)])
            live = np.repeat(count > 1, count) & (k == 0)
            refs, data = grouped(r[live], v[live])
            yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array(data, pa.binary())], names=["ref", "data"])
        del vs, rs, ks
        trimmed()

    asked = src.select("_ref", "text").mapInArrow(ask, "bucket int, kind int, ref long, data binary")
    return dealt(asked, n, "bucket").mapInArrow(answer, "ref long, data binary")


_STEP = "kind int, doc_id long, n_words long, kept_sha256 string, block long, bucket int, data binary"


def _step(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "doc_id", "n_words", "kept_sha256", "block", "bucket", "data"])


def _kmers(w: _Words, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word before, word after) of the k-mers that begin at `live`."""
    e = rolling(w.h, w.window)[live] if len(live) else np.zeros(0, np.uint64)
    sig = (w.h >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
    doc = w.doc[live]
    before = np.where(live > w.first[doc], sig[np.maximum(live - 1, 0)], _EDGE_OF_TEXT)
    after = np.where(live + w.window < w.first[doc + 1], sig[np.minimum(live + w.window, max(len(sig) - 1, 0))], _EDGE_OF_TEXT) if len(live) else np.zeros(0, np.uint32)
    return e, before, after


def _merged(e: np.ndarray, count: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By distinct k-mer: hash, count, the one word before and after (_MANY if several); and each row's place among them."""
    order = np.argsort(e, kind="stable")
    e = e[order]
    new = np.r_[True, e[1:] != e[:-1]] if len(e) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    if not len(at):
        return e, count, before, after, np.zeros(0, np.int64)
    place = np.empty(len(e), np.int64)
    place[order] = np.cumsum(new) - 1
    one = lambda x: np.where(np.minimum.reduceat(x, at) == np.maximum.reduceat(x, at), x[at], _MANY)
    return e[at], np.add.reduceat(count[order], at, dtype=np.uint64), one(before[order]), one(after[order]), place


def _edge_step(src: DataFrame, anchors: DataFrame, n: int, window: int, anchor: int) -> DataFrame:
    """kind 0: finished documents; 1: blocks of the others; 2: their k-mers, to be counted."""
    found = anchors.groupBy("ref").agg(F.collect_list("data").alias("_data"))  # at most a document's anchors
    rows = src.join(found, src["_ref"] == found["ref"], "left").select("doc_id", "_ref", "text", "_data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, block = WordHash(), TaskContext.get().partitionId() << 32
        for p in pieces(batches, 2):
            texts, out = p.column(2).cast(pa.binary()).to_pylist(), []
            w = _Words(texts, hashes, window, anchor)
            low, _, _ = w.anchors()
            bounds = np.searchsorted(w.starts, w.first)
            live = []
            for i, data in enumerate(p.column(3).to_pylist()):
                at = w.starts[bounds[i] : bounds[i + 1]]
                at = at[np.isin(low[bounds[i] : bounds[i + 1]], np.frombuffer(b"".join(data), np.uint64))] if data and len(at) else at[:0]
                live.append(at)
            doc_ids, refs = p.column(0).to_pylist(), p.column(1).to_pylist()
            held = [i for i, at in enumerate(live) if len(at)]
            for i, words in enumerate(w.split):
                if not len(live[i]):
                    out.append((0, doc_ids[i], len(words), hashlib.sha256(b" ".join(words)).hexdigest(), 0, 0, None))
            if held:
                kept = pickle.dumps(([doc_ids[i] for i in held], [refs[i] for i in held], [texts[i] for i in held], [(live[i] - w.first[i]).astype(np.int32) for i in held]), protocol=5)
                out.append((1, None, None, None, block, 0, kept))
                at = np.concatenate([live[i] for i in held])
                e, before, after = _kmers(w, at)
                e, count, before, after, _ = _merged(e, np.ones(len(e), np.uint32), before, after)
                edges = bucket_edges(e, n)
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    s, t = edges[k], edges[k + 1]
                    out.append((2, None, None, None, block, k, b"".join(x[s:t].tobytes() for x in (e, count.astype(np.uint32), before, after))))
                block += 1
            yield _step(out)
        del hashes
        trimmed()

    return written(rows.mapInArrow(run, _STEP), "edges", "kind")


def packed_edges(count: np.ndarray, one_before: np.ndarray, one_after: np.ndarray) -> np.ndarray:
    """times << 2 | one predecessor << 1 | one successor, in 64 bits: counts below 2^62 keep their value."""
    return count.astype(np.uint64) << _TWO | one_before.astype(np.uint64) << _ONE | one_after.astype(np.uint64)


def _edge_answers(asked: DataFrame, n: int) -> DataFrame:
    """block, bucket, data: packed_edges of each k-mer that a block asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, parts = [], []
        for b in batches:
            for block, bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = data.as_buffer()
                m = len(raw) // 20
                parts.append((np.frombuffer(raw, np.uint64, m), *[np.frombuffer(raw, np.uint32, m, 8 * m + 4 * m * k) for k in range(3)]))
                rows.append((block, bucket, m))
        if rows:
            _, count, before, after, place = _merged(*[np.concatenate(x) for x in zip(*parts, strict=True)])
            told, at = packed_edges(count, before != _MANY, after != _MANY)[place], np.r_[0, np.cumsum([m for *_, m in rows])].tolist()
            for k in range(0, len(rows), 500):
                some = rows[k : k + 500]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.int32()), pa.array([struct.pack("<I", x[2]) + planes(told[at[k + j] : at[k + j + 1]]) for j, x in enumerate(some)], pa.binary())], names=["block", "bucket", "data"])
        del rows, parts
        trimmed()

    return dealt(asked.select("block", "bucket", "data"), n, "bucket").mapInArrow(run, "block long, bucket int, data binary")


_PATH = "a long, b long, length int, doc_id long, ref long, start int, block long, at int"


def _together(n: int, *parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.repartition(n, "block").sortWithinPartitions("block", "kind", "bucket")


def _paths(blocks: DataFrame, answers: DataFrame, n: int, window: int, anchor: int) -> DataFrame:
    """A row for each place of a nonbranching path: 128-bit hash of its words, k-mers, and source coordinates."""
    both = _together(n, blocks.select("block", F.lit(0).alias("kind"), "bucket", "data"), answers.select("block", F.lit(1).alias("kind"), "bucket", "data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for block, rows in by_block(batches):
            doc_ids, refs, texts, live = pickle.loads(rows[0][2])
            w = _Words(texts, hashes, window, anchor)
            at = np.concatenate([x + w.first[i] for i, x in enumerate(live)])
            e, before, after = _kmers(w, at)
            *_, place = _merged(e, np.ones(len(e), np.uint32), before, after)
            told = np.concatenate([from_planes(r[2], struct.unpack_from("<I", r[2])[0], 4) for r in rows[1:]])[place]
            times = told >> _TWO
            again = times > _ONE
            joined = np.zeros(len(at), bool)
            joined[1:] = again[1:] & again[:-1] & (at[1:] == at[:-1] + 1) & (w.doc[at[1:]] == w.doc[at[:-1]]) & (times[1:] == times[:-1]) & ((told[1:] & _TWO) > 0) & ((told[:-1] & _ONE) > 0)
            heads = np.flatnonzero(again & ~joined)
            stops = np.flatnonzero(~joined)
            ends = np.r_[stops, len(at)][np.searchsorted(stops, heads) + 1]
            docs = w.doc[at[heads]]
            starts = at[heads] - w.first[docs]
            out = []
            for i, s, m in zip(docs.tolist(), starts.tolist(), (ends - heads).tolist(), strict=True):
                h = xxhash.xxh3_128_intdigest(b" ".join(w.split[i][s : s + m + window - 1]))
                out.append((h & (2**64 - 1), h >> 64, m, doc_ids[i], refs[i], s, block, i))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            sign = lambda c: np.array(c, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sign(cols[0])), pa.array(sign(cols[1])), pa.array(cols[2], pa.int32()), pa.array(list(cols[3]), pa.int64()), pa.array(list(cols[4]), pa.int64()), pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.int64()), pa.array(cols[7], pa.int32())], names=["a", "b", "length", "doc_id", "ref", "start", "block", "at"])

    return written(both.mapInArrow(run, _PATH), "paths")


def _removed(blocks: DataFrame, marked: DataFrame, n: int, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the blocks' documents, less the words on marked paths."""
    spans = marked.groupBy("block").agg(F.collect_list(F.struct("at", "start", "length")).alias("spans"))  # at most a block's paths
    both = blocks.select("block", "data").join(spans, "block", "left").select("block", "data", "spans.at", "spans.start", "spans.length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, at, start, length in zip(b.column(1), *[b.column(k).to_pylist() for k in (2, 3, 4)], strict=True):
                doc_ids, _, texts, _ = pickle.loads(data.as_buffer())
                by: dict[int, list[tuple[int, int]]] = {}
                for i, s, m in zip(at or [], start or [], length or [], strict=True):
                    by.setdefault(i, []).append((s, s + m + window - 1))
                out = []
                for i, t in enumerate(texts):
                    words = (t or b"").split()
                    gone = np.zeros(len(words) + 1, np.int32)
                    for s, e in by.get(i, ()):
                        gone[s] += 1
                        gone[e] -= 1
                    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist() if i in by else range(len(words))
                    out.append((doc_ids[i], len(words), len(words) - len(kept), hashlib.sha256(b" ".join([words[k] for k in kept])).hexdigest()))
                cols = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.string()], strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def repeated_paths(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(finished documents, blocks of the others, paths with `first` = whether this place owns the path)."""
    n = buckets_for(docs)
    src = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("_ref"))
    anchors = written(_anchor_rows(src, n, window, anchor), "anchors")
    step = _edge_step(src, anchors, n, window, anchor)
    dropped(anchors)
    done, blocks, asked = [step.filter(F.col("kind") == k) for k in range(3)]
    answers = written(_edge_answers(asked, n), "edge-answers")
    paths = _paths(blocks, answers, n, window, anchor)
    dropped(answers)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("ref").alias("r"), F.col("start").alias("s"))
    first = written(paths.groupBy("a", "b").agg(F.min(order).alias("own")), "owners").withColumnsRenamed({"a": "a2", "b": "b2"})
    paths = paths.join(first, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2"))).withColumn("first", F.col("own") == order).drop("a2", "b2", "own")
    return done, blocks, paths


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: a row a document."""
    n = buckets_for(docs)
    done, blocks, paths = repeated_paths(docs, window, anchor)
    marked = written(paths.filter("not first"), "marked")
    return done.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256").unionAll(_removed(blocks, marked, n, window))

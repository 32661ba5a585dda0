"""LM scoring by a weighted backoff automaton that is never in one place.

Tokens are the words of a text (A-Z lowered), then one end. The states are the n-grams seen in training, of ORDER - 1 = 2 words
at most, and the root. With c training counts, N tokens and V distinct ones, and m(k) = STRENGTH[k - 1]:

    root         w weighs p(w) = (c(w) + 1) / (N + V + 1)
    state u      w weighs p(w | u) = (c(u w) + m(1) p(w)) / (c(u) + m(1)) if u w was seen; else failure arc m(1) / (c(u) + m(1)) to the root
    state t u    w weighs p(w | t u) = (c(t u w) + m(2) p(w | u)) / (c(t u) + m(2)) if t u w was seen; else failure arc m(2) / (c(t u) + m(2)) to u

and every state's weights sum to one over all words and one unknown word. The walk begins in the state of the end token. Token
by token, from left to right, it takes the arc or falls along failure arcs until there is one, adds up their log10 weights, and
carries on in the state of the longest seen n-gram that now ends the text: two words, one, or the root after an unknown one.

The automaton grows with the corpus, so it is dealt over the cluster by hash, and a block of documents is given just the states
and arcs that it walks. Blocks ask for the counts of their distinct words and pairs, then of their distinct triples; a triple
one of whose pairs stands in this block alone is known there and not asked for. Buckets add up what the blocks have counted and
answer in the order asked (packed.py), so a word or pair that fills a third of the corpus reaches its bucket once a block. The
number of buckets follows the input's size, so what a task holds does not grow with it. Counts have 64 bits. Only N and V, one
row a bucket, come to the driver.

Defined results: null text is empty and has the end token only; a null doc_id counts as the empty text in the held-out rule;
repeated rows each count and each get a row. Without any training document all counts are zero. An empty table gives an empty
table. Words, pairs and triples are told apart by 64-bit hashes.
"""

from __future__ import annotations

import pickle
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written
from .packed import WordHash, bucket_edges, buckets_for, by_block, dealt, from_planes, gathered, mixed, planes, trimmed

ORDER = 3
#: Weight, in tokens, of the shorter context's distribution in a state of one word and of two.
STRENGTH = (100.0, 20.0)
FOLDS, HELD_OUT = 7, 2
LM_BLOCK_BYTES = 4_000_000
_END, _ONE = np.uint64(0xE11D), np.uint64(1)
_ROW = "block long, kind int, bucket int, data binary"
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Kinds of rows: a block's tokens; what it asks, or is told, of n-grams of one, two and three words; a bucket's sums.
TOKENS, SUMS = 0, 9


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, low six bytes and high two apart: the high ones are mostly zero."""
    d = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return struct.pack("<I", len(keys)) + d[:, :6].tobytes() + d[:, 6:].tobytes()


def _keys(raw: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<I", raw)
    d = np.empty((n, 8), np.uint8)
    d[:, :6] = np.frombuffer(raw, np.uint8, 6 * n, 4).reshape(-1, 6)
    d[:, 6:] = np.frombuffer(raw, np.uint8, 2 * n, 4 + 6 * n).reshape(-1, 2)
    return np.cumsum(d.view(np.uint64).ravel(), dtype=np.uint64)


def _squeezed(ranks: np.ndarray) -> bytes:
    """Ranks by frequency, a plane for each of their bytes, compressed."""
    return zlib.compress(planes(ranks), 1)


def _unsqueezed(raw: bytes, n: int) -> np.ndarray:
    return from_planes(zlib.decompress(raw), n).astype(np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["block", "kind", "bucket", "data"])


def _asked(block: int, keys: np.ndarray, counts: np.ndarray, n: int, kind: int) -> list[tuple]:
    """Rows that ask for sorted distinct keys, with what this block has counted."""
    edges = bucket_edges(keys, n)
    return [(block, kind, k, _steps(keys[edges[k] : edges[k + 1]]) + planes(counts[edges[k] : edges[k + 1]])) for k in np.flatnonzero(np.diff(edges)).tolist()]


def _joined(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A key of a followed by b."""
    return mixed(mixed(a * np.uint64(0xD1342543DE82EF95) + np.uint64(salt)) + b)


class _Block:
    """The tokens of a block of documents as places in its sorted distinct words, and its distinct pairs and triples."""

    def __init__(self, doc_ids: list, size: np.ndarray, vocab: np.ndarray, place: np.ndarray):
        self.doc_ids, self.size, self.vocab, self.place = doc_ids, size, vocab, place
        self.train = np.repeat(np.array([not held_out(d) for d in doc_ids], bool), size)
        self.first = np.r_[0, np.cumsum(size)[:-1]]
        self.end = int(np.searchsorted(vocab, _END))
        self.before = np.r_[self.end, place[:-1]]
        self.before[self.first] = self.end
        self.pair_key = _joined(vocab[self.before], vocab[place], 1)
        self.pairs, self.pair = np.unique(self.pair_key, return_inverse=True)

    @classmethod
    def of(cls, doc_ids: list, texts: list[bytes | None], hashes: WordHash) -> _Block:
        split = [(t or b"").lower().split() for t in texts]
        size = np.array([len(w) for w in split], np.int64)
        h = np.concatenate([hashes.of(w) for w in split])
        del split
        return cls(doc_ids, size + 1, *np.unique(np.insert(h, np.cumsum(size), _END), return_inverse=True))

    @classmethod
    def loaded(cls, raw: bytes) -> _Block:
        doc_ids, size, often, ranks = pickle.loads(raw)
        order = np.argsort(often)
        at = np.empty(len(often), np.int64)
        at[order] = np.arange(len(often))
        return cls(doc_ids, size, often[order], at[_unsqueezed(ranks, int(size.sum()))])

    def dumped(self) -> bytes:
        often = np.argsort(-np.bincount(self.place, minlength=len(self.vocab)), kind="stable")
        rank = np.empty(len(often), np.int64)
        rank[often] = np.arange(len(often))
        return pickle.dumps((self.doc_ids, self.size, self.vocab[often], _squeezed(rank[self.place])), protocol=5)

    def counted(self, places: np.ndarray, n: int, on: np.ndarray | None = None) -> np.ndarray:
        """How often each of n distinct values stands in this block's training documents."""
        return np.bincount(places[self.train if on is None else on & self.train], minlength=n)

    def told(self, rows: list[tuple]) -> None:
        """Take in the answers for words and pairs, and find the triples, of which `open` must be asked for."""
        self.count = (_answer(rows, 1) >> _ONE).astype(np.int64)
        pairs = _answer(rows, 2)
        alone = (pairs & _ONE) > 0
        self.arc2 = (pairs >> _ONE).astype(np.int64)[self.pair]
        inner = np.ones(len(self.place), bool)
        inner[self.first] = False  # the first token follows the end alone
        self.context2 = np.where(inner, np.r_[0, self.arc2[:-1]], 0)
        key = _joined(np.r_[np.uint64(0), self.pair_key[:-1]], self.vocab[self.place], 2)[inner]
        self.triples, place = np.unique(key, return_inverse=True)
        self.triple = np.full(len(self.place), -1)
        self.triple[inner] = place
        self.own = self.counted(self.triple, len(self.triples), inner)
        shut = alone[self.pair]
        shut = (shut | np.r_[False, shut[:-1]])[inner]
        self.open = np.ones(len(self.triples), bool)
        self.open[place[shut]] = False

    def walked(self, rows: list[tuple], total: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
        """(base, model) log10 weights of each token."""
        triples = self.own.astype(np.int64)
        triples[self.open] = (_answer(rows, 3) >> _ONE).astype(np.int64)
        arc3 = np.where(self.triple >= 0, triples[self.triple], 0) if len(triples) else np.zeros(len(self.place), np.int64)
        m1, m2 = STRENGTH
        p1 = ((self.count + 1) / (total + distinct + 1))[self.place]
        context1 = self.count[self.before].astype(np.float64)
        p2 = (self.arc2 + m1 * p1) / (context1 + m1)
        p3 = (arc3 + m2 * p2) / (self.context2 + m2)
        base = np.log10(p1)
        # the state that the token before has led to, as the number of its words
        state = np.where(self.context2 > 0, 2, np.where(context1 > 0, 1, 0))
        out = np.zeros(len(base))
        two = state == 2
        out[two] = np.log10(np.where(arc3 > 0, p3, m2 / (self.context2 + m2)))[two]
        state[two & (arc3 == 0)] = 1  # the failure arc drops the oldest word
        one = state == 1
        one &= ~(two & (arc3 > 0))
        out[one] += np.log10(np.where(self.arc2 > 0, p2, m1 / (context1 + m1)))[one]
        state[one & (self.arc2 == 0)] = 0
        out[state == 0] += base[state == 0]
        return base, out


def _answer(rows: list[tuple], kind: int) -> np.ndarray:
    """What the buckets have told a block, in the order of its keys: twice the count, and one more where no other block asked."""
    found = []
    for k, _, data in rows:
        if k == kind:
            (n,) = struct.unpack_from("<I", data)
            found.append(from_planes(data, n, 4))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _tokens(docs: DataFrame) -> DataFrame:
    """The written table of the blocks' tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, block = WordHash(), TaskContext.get().partitionId() << 32
        for ids, texts in gathered(batches, LM_BLOCK_BYTES):
            b = _Block.of(ids, texts, hashes)
            texts.clear()
            yield _batch([(block, TOKENS, 0, b.dumped())])
            del b
            block += 1
        del hashes
        trimmed()

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ROW), "tokens", batch=1_000)


def _first_asked(tokens: DataFrame, n: int) -> DataFrame:
    """What the blocks ask of words and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = _Block.loaded(data.as_buffer())
                yield _batch(_asked(block, b.vocab, b.counted(b.place, len(b.vocab)), n, 1))
                yield _batch(_asked(block, b.pairs, b.counted(b.pair, len(b.pairs)), n, 2))
                del b
        trimmed()

    return tokens.select("block", "data").mapInArrow(run, _ROW)


def _answers(asked: DataFrame, n: int, name: str) -> DataFrame:
    """For each row asked, one with twice the global counts, plus one for what one block alone asked for; for words also a row with
    a bucket's sums."""

    def summed(kind: int, bucket: int, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, count = (np.concatenate([r[k] for r in rows]) for k in (1, 2))
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        at = np.flatnonzero(new)
        total = np.add.reduceat(count[order], at)
        told = total << 1 | (np.diff(np.r_[at, len(key)]) == 1)
        count[order] = told[np.cumsum(new) - 1]
        if kind == 1:
            yield _batch([(-1, SUMS, bucket, struct.pack("<2q", int(total.sum()), int((total > 0).sum())))])
        at = 0
        out = []
        for block, k, _ in rows:
            out.append((block, kind, bucket, struct.pack("<I", len(k)) + planes(count[at : at + len(k)])))
            at += len(k)
            if len(out) == 500:
                yield _batch(out)
                out = []
        yield _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            for block, kind, bucket, data in zip(*[b.column(k).to_pylist() for k in range(3)], b.column(3), strict=True):
                raw = data.as_buffer().to_pybytes()
                keys = _keys(raw)
                held.setdefault((kind, bucket), []).append((block, keys, from_planes(raw, len(keys), 4 + 8 * len(keys)).astype(np.int64)))
        for key in sorted(held):
            yield from summed(*key, held.pop(key))
        trimmed()

    return written(dealt(asked, n, "bucket").mapInArrow(run, _ROW), name, "kind", batch=20)


def _met(n: int, *parts: DataFrame) -> DataFrame:
    out = parts[0].select("block", "kind", "bucket", "data")
    for p in parts[1:]:
        out = out.unionAll(p.select("block", "kind", "bucket", "data"))
    return out.repartition(n, "block").sortWithinPartitions("block", "kind", "bucket")


def lm_score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row a document."""
    n = buckets_for(docs)
    tokens = _tokens(docs)
    first = _answers(_first_asked(tokens, n), n, "words-pairs")
    sums = [struct.unpack("<2q", r["data"]) for r in first.filter(F.col("kind") == SUMS).select("data").collect()]  # a row a bucket
    total, distinct = (sum(x[k] for x in sums) for k in range(2))
    known = first.filter(F.col("kind") != SUMS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in by_block(batches):
            b = _Block.loaded(rows[0][2])
            b.told(rows)
            yield _batch(_asked(block, b.triples[b.open], b.own[b.open], n, 3))
            del b
        trimmed()

    second = _answers(_met(n, tokens, known).mapInArrow(ask, _ROW), n, "triples")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_block(batches):
            b = _Block.loaded(rows[0][2])
            b.told(rows)
            base, score = b.walked(rows, total, distinct)
            add = lambda x: np.add.reduceat(x, b.first)  # noqa: B023, E731
            cols = [
                pa.array(b.doc_ids, pa.int64()), pa.array([held_out(d) for d in b.doc_ids], pa.bool_()), pa.array(b.size, pa.int64()), pa.array(add((b.count > 0)[b.place].astype(np.int64))),
                pa.array(np.full(len(b.size), total, np.int64)), pa.array(add(base)), pa.array(add(score)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _OUT.split(", ")])
            del b, base, score
        trimmed()

    out = written(_met(n, tokens, known, second).mapInArrow(walk, _OUT), "scores", batch=20)
    for table in (tokens, first, second):
        dropped(table)
    return out

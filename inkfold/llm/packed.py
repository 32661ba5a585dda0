"""Exchanges of packed rows: a task sends one row of NumPy bytes to each bucket instead of a row for each value.

A value's bucket follows from its 64-bit hash and rises with it, so the answers of all buckets, in order, line up with the
sorted distinct values of the block that asked. Blocks send each distinct value once, with what they have counted, so a value
that stands everywhere reaches its bucket once a block at most.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a task takes apart at once, and words whose hashes it remembers.
BLOCK_BYTES = 3_000_000
CACHE_WORDS = 200_000
#: Input bytes, as stored, for each bucket.
BUCKET_BYTES = 32_000_000
_SEED = 0x5EED


class WordHash(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, _SEED)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k values from each position on; the last k - 1 positions have none."""
    base, out, width, power, done = 0xD1342543DE82EF95, None, 1, h, 0
    while True:
        if k & width:
            if out is None:
                out = power
            else:  # out covers `done` values; put `power` after it
                n = len(h) - done - width + 1
                out = out[:n] * np.uint64(pow(base, width, 1 << 64)) + power[done : done + n]
            done += width
        if done == k:
            return mixed(out)
        n = len(power) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        power = power[:n] * np.uint64(pow(base, width, 1 << 64)) + power[width : width + n]
        width *= 2


def sliding(x: np.ndarray, k: int, least: bool = True) -> np.ndarray:
    """Least (or greatest) of the k values from each position on."""
    pick, width = (np.minimum if least else np.maximum), 1
    while 2 * width <= k:
        x = pick(x[:-width], x[width:]) if len(x) > width else x[:0]
        width *= 2
    rest = k - width
    return pick(x[:-rest], x[rest:]) if rest and len(x) > rest else (x if not rest else x[:0])


def trimmed() -> None:
    """Give memory that a finished task no longer uses back to the machine: Python workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text, a row at least."""
    for b in batches:
        size = pa.compute.fill_null(pa.compute.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        at = 0
        ends = np.cumsum(size)
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield b.slice(at, to - at)
            at = to


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list]]:
    """(first column, texts as bytes) of batches(id, text), gathered to about `most` bytes of text whatever the batches' sizes."""
    ids, texts, size = [], [], 0
    for p in pieces(batches, 1, most):
        more = p.column(1).cast(pa.binary()).to_pylist()
        n = sum(len(t) for t in more if t)
        if size and size + n > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids += p.column(0).to_pylist()
        texts += more
        size += n
    if ids:
        yield ids, texts


def bucket_edges(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n buckets begins in sorted hashes, and the end."""
    inner = np.searchsorted(sorted_hashes, np.array([-(-(b << 64) // n) for b in range(1, n)], np.uint64))
    return np.r_[0, inner, len(sorted_hashes)]


def planes(x: np.ndarray) -> bytes:
    """Counts as planes of their bytes, lowest first, as many as the greatest needs (a first byte tells); high ones compress away."""
    x = x.astype("<u8", copy=False)
    k = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([k]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes()


def from_planes(raw: bytes, n: int, at: int = 0) -> np.ndarray:
    raw = memoryview(raw)
    out = np.zeros((n, 8), np.uint8)
    out[:, : raw[at]] = np.frombuffer(raw, np.uint8, n * raw[at], at + 1).reshape(raw[at], n).T
    return out.view("<u8").ravel()


def buckets_for(df: DataFrame) -> int:
    """How many buckets to deal into: spark.sql.shuffle.partitions, and more where a bucket's share of the stored input would exceed
    BUCKET_BYTES."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)  # what has no known size is given as greater
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // BUCKET_BYTES), 1 << 20))


def dealt(df: DataFrame, n: int, column: str) -> DataFrame:
    """df in n partitions, a row in the one that the column numbers."""
    return df.repartitionById(n, F.col(column).cast("int"))


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(block, rows) of rows sorted by their first column."""
    now, rows = None, []
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for row in zip(*cols, strict=True):
            if row[0] != now:
                if rows:
                    yield now, rows
                now, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield now, rows

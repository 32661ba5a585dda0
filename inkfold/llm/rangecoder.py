"""An adaptive context-mixing range coder for ids, all blocks of a frame in step as NumPy lanes.

A block holds BLOCK ids at most; its model starts afresh, so blocks decode independently. Before each id the model predicts:
order 2, the id last seen after the two ids before; order 1, the id last seen after the one before; order 0, adaptive
frequencies of the id's bit length. Each prediction carries a confidence (its run of hits), and for each confidence the chance
that such predictions hold is learnt in the block; these chances mix the three orders into one distribution: the order-2 id
gets its share, the order-1 id its share of the rest, and the bit lengths what is left. The symbol narrows a 48-bit range; an
id that neither prediction gave then codes the bits below its leading one. Carries are resolved when a block is closed.

Frame layout, little-endian: b"IKF2", ids to a block (u32), bit lengths (u32), documents (u32), blocks (u32), ids (u64); the
CRC-32 of all that stands before the words but itself (u32); per document its id (i64, with a null flag in a bitmap) and length
(u32); per block its number of 16-bit words (u32), their CRC-32 (u32) and that of its ids as u32 (u32); then the words of all
blocks, and nothing after them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
MAX_ID = (1 << 17) - 1
MAGIC = b"IKF2"
_HEAD = "<4sIIIIQ"
_TABLE = 11
_CONF = 16
_TOP, _WORD = np.uint64(1 << 32), np.uint64(0xFFFFFFFF)
_S16, _S32 = np.uint64(16), np.uint64(32)
_TOTAL = 1 << 16
_CDF = 15


class FrameError(ValueError):
    """A frame is damaged."""


class _Model:
    """The lanes' predictions; shares() before and update() after each id."""

    def __init__(self, lanes: int, classes: int):
        self.k = classes
        self.base = np.arange(lanes, dtype=np.int64) << _TABLE
        self.abase = np.arange(lanes, dtype=np.int64) * _CONF
        self.one, self.two = np.zeros(lanes << _TABLE, np.int32), np.zeros(lanes << _TABLE, np.int32)
        start = np.array([1 << 12, *[int(65000 * (c + 0.4) / (c + 1.2)) for c in range(1, _CONF)]], np.int32)
        self.a1, self.a2 = np.tile(start, lanes), np.tile(start, lanes)
        even = (np.arange(classes + 1) << _CDF) // classes
        self.cdf = np.tile(even.astype(np.int32), (lanes, 1))
        step = np.arange(classes + 1)
        self.mix = np.where(step[None, :] <= np.arange(classes)[:, None], step, (1 << _CDF) - classes + step).astype(np.int32)
        self.prev1, self.prev2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.avail = _TOTAL - classes - 2

    def shares(self, n: int) -> tuple:
        mask = (1 << _TABLE) - 1
        p1 = self.prev1[:n]
        h = p1 * 40503
        self.i1 = self.base[:n] + ((h >> 5) & mask)
        self.i2 = self.base[:n] + (((h + self.prev2[:n] * 60493) >> 7) & mask)
        self.e1, self.e2 = self.one[self.i1], self.two[self.i2]
        self.c1, self.c2 = self.abase[:n] + (self.e1 & 15), self.abase[:n] + (self.e2 & 15)
        self.w1, self.w2 = self.a1[self.c1], self.a2[self.c2]
        f2 = (self.w2.astype(np.int64) * self.avail) >> 16
        f1 = (self.w1 * (self.avail - f2)) >> 16
        return self.e1 >> 4, self.e2 >> 4, f1 + 1, f2 + 1, self.avail - f2 - f1

    def update(self, n: int, ids: np.ndarray, hit1: np.ndarray, hit2: np.ndarray, missed: np.ndarray, cls: np.ndarray) -> None:
        """hit1: the order-1 id held, whatever order 2 gave; missed: the lanes whose bit length was coded."""
        fresh = (ids << 4).astype(np.int32)
        for table, at, e, hit in ((self.one, self.i1, self.e1, hit1), (self.two, self.i2, self.e2, hit2)):
            c = e & 15
            table[at] = np.where(hit, e + (c < 15), np.where(c < 2, fresh, e - c + (c >> 1)))
        self.a2[self.c2] = self.w2 + ((hit2 * np.int32(65408) + 64 - self.w2) >> 4)
        a1 = self.w1 + ((hit1 * np.int32(65408) + 64 - self.w1) >> 4)
        self.a1[self.c1] = np.where(hit2, self.w1, a1)
        own = self.cdf[missed]
        self.cdf[missed] = own + ((self.mix[cls[missed]] - own) >> 5)
        self.prev2[:n] = self.prev1[:n]
        self.prev1[:n] = ids


def _bit_lengths() -> np.ndarray:
    return np.array([i.bit_length() for i in range(MAX_ID + 1)], np.int64)


_LENGTH: np.ndarray | None = None


def _lengths() -> np.ndarray:
    global _LENGTH
    if _LENGTH is None:
        _LENGTH = _bit_lengths()
    return _LENGTH


def encode_blocks(ids: np.ndarray, classes: int) -> list[np.ndarray]:
    """The 16-bit words of each block of ids."""
    total = len(ids)
    lanes = -(-total // BLOCK)
    if not lanes:
        return []
    grid = np.zeros(lanes * BLOCK, np.int32)
    grid[:total] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, BLOCK).T)
    last = total - (lanes - 1) * BLOCK
    model, length = _Model(lanes, classes), _lengths()
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 48) - 1, np.uint64)
    width = 2 * BLOCK + 8
    words, at = np.zeros(lanes * width, np.uint32), np.arange(lanes, dtype=np.int64) * width
    first = at.copy()

    def renorm(n: int) -> None:
        small = rng[:n] < _TOP
        words[at[:n]] = low[:n] >> _S32
        at[:n] += small
        shift = small.astype(np.uint64) << np.uint64(4)
        rng[:n] <<= shift
        low[:n] = np.where(small, (low[:n] & _WORD) << _S16, low[:n])

    for t in range(min(BLOCK, total)):
        n = lanes if t < last else lanes - 1
        x = grid[t, :n].astype(np.int64)
        q1, q2, f1, f2, rest = model.shares(n)
        hit1, hit2 = q1 == x, q2 == x
        missed = np.flatnonzero(~(hit1 | hit2))
        cls = length[x]
        start, freq = np.where(hit2, 0, f2), np.where(hit2, f2, f1)
        if len(missed):
            c, r = cls[missed], rest[missed]
            a = (r * model.cdf[missed, c]) >> _CDF
            b = (r * model.cdf[missed, c + 1]) >> _CDF
            start[missed] = f1[missed] + f2[missed] + c + a
            freq[missed] = 1 + b - a
        r = rng[:n] >> _S16
        low[:n] += start.astype(np.uint64) * r
        rng[:n] = freq.astype(np.uint64) * r
        renorm(n)
        if len(missed):
            bits = np.zeros(n, np.int64)
            bits[missed] = np.maximum(cls[missed] - 1, 0)
            off = np.where(bits > 0, x - (np.int64(1) << bits), 0)
            off[bits == 0] = 0
            rng[:n] >>= bits.astype(np.uint64)
            low[:n] += off.astype(np.uint64) * rng[:n]
            renorm(n)
        model.update(n, x, hit1, hit2, missed, cls)
    for _ in range(3):
        words[at] = low >> _S32
        at += 1
        low = (low & _WORD) << _S16
    out = []
    for i in range(lanes):
        w = words[first[i] : at[i]]
        while len(over := np.flatnonzero(w >> 16)):
            w[over] &= 0xFFFF
            w[over[over > 0] - 1] += 1
        out.append(w.astype("<u2"))
    return out


def decode_blocks(words: list[np.ndarray], total: int, classes: int) -> np.ndarray:
    lanes = len(words)
    if not lanes:
        return np.zeros(0, np.int64)
    last = total - (lanes - 1) * BLOCK
    size = np.array([len(w) for w in words])
    stream = np.zeros(int(size.sum()) + 3 * lanes, np.uint64)
    first = np.r_[0, np.cumsum(size + 3)[:-1]]
    for f, w in zip(first.tolist(), words, strict=True):
        stream[f : f + len(w)] = w
    at = first.copy()
    limit = first + size + 2
    code = np.zeros(lanes, np.uint64)
    for _ in range(3):
        code = (code << _S16) | stream[at]
        at += 1
    rng = np.full(lanes, (1 << 48) - 1, np.uint64)
    grid = np.zeros((BLOCK, lanes), np.int32)
    model = _Model(lanes, classes)
    steps = np.arange(classes + 1)

    def renorm(n: int) -> None:
        small = rng[:n] < _TOP
        shift = small.astype(np.uint64) << np.uint64(4)
        rng[:n] <<= shift
        code[:n] = (code[:n] << shift) | np.where(small, stream[np.minimum(at[:n], limit[:n])], np.uint64(0))
        at[:n] += small

    for t in range(min(BLOCK, total)):
        n = lanes if t < last else lanes - 1
        q1, q2, f1, f2, rest = model.shares(n)
        r = rng[:n] >> _S16
        v = np.minimum(code[:n] // r, np.uint64(_TOTAL - 1)).astype(np.int64)
        hit2 = v < f2
        missed = np.flatnonzero(v >= f2 + f1)
        x = np.where(hit2, q2, q1).astype(np.int64)
        start, freq = np.where(hit2, 0, f2), np.where(hit2, f2, f1)
        cls = np.zeros(n, np.int64)
        if len(missed):
            u = v[missed] - f2[missed] - f1[missed]
            edge = ((rest[missed, None] * model.cdf[missed]) >> _CDF) + steps
            c = (edge[:, 1:] <= u[:, None]).sum(axis=1)
            c = np.minimum(c, classes - 1)
            rows = np.arange(len(missed))
            cls[missed] = c
            start[missed] = f1[missed] + f2[missed] + edge[rows, c]
            freq[missed] = edge[rows, c + 1] - edge[rows, c]
        code[:n] -= start.astype(np.uint64) * r
        rng[:n] = freq.astype(np.uint64) * r
        renorm(n)
        if len(missed):
            bits = np.zeros(n, np.int64)
            bits[missed] = np.maximum(cls[missed] - 1, 0)
            rng[:n] >>= bits.astype(np.uint64)
            off = np.where(bits > 0, (code[:n] // rng[:n]).astype(np.int64), 0)
            code[:n] -= off.astype(np.uint64) * rng[:n]
            x[missed] = np.where(cls[missed] > 0, (np.int64(1) << bits[missed]) + off[missed], 0)
            renorm(n)
        grid[t, :n] = x
        model.update(n, x, (q1 == x), hit2, missed, cls)
    return np.ascontiguousarray(grid.T).reshape(-1)[: (lanes - 1) * BLOCK + last]


def encode_frame(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    if len(ids) and (ids.min() < 0 or ids.max() > MAX_ID):
        raise FrameError(f"ids must lie in 0..{MAX_ID}")
    classes = int(ids.max()).bit_length() + 1 if len(ids) else 1
    words = [w.tobytes() for w in encode_blocks(ids, classes)]
    raw = ids.astype("<u4")
    head = struct.pack(_HEAD, MAGIC, BLOCK, classes, len(doc_ids), len(words), len(ids))
    known = np.array([d is not None for d in doc_ids], bool)
    tables = b"".join([
        np.packbits(known, bitorder="little").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        lengths.astype("<u4").tobytes(),
        np.array([len(w) // 2 for w in words], "<u4").tobytes(),
        np.array([zlib.crc32(w) for w in words], "<u4").tobytes(),
        np.array([zlib.crc32(raw[k * BLOCK : (k + 1) * BLOCK]) for k in range(len(words))], "<u4").tobytes(),
    ])
    return b"".join([head, struct.pack("<I", zlib.crc32(tables, zlib.crc32(head))), tables, *words])


def decode_frame(frame: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, ids); FrameError if any byte doesn't fit its checksum."""
    size = struct.calcsize(_HEAD)
    try:
        magic, block, classes, docs, blocks, total = struct.unpack_from(_HEAD, frame)
        (told,) = struct.unpack_from("<I", frame, size)
    except struct.error as e:
        raise FrameError("no header") from e
    if magic != MAGIC or block != BLOCK:
        raise FrameError("not a frame of this version")
    start = at = size + 4
    end = start + -(-docs // 8) + 12 * docs + 12 * blocks
    if len(frame) < end or zlib.crc32(frame[start:end], zlib.crc32(frame[:size])) != told:
        raise FrameError("header")

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(frame, kind, n, at)
        at += out.nbytes
        return out

    known = np.unpackbits(take("u1", -(-docs // 8)), bitorder="little")[:docs]
    doc_ids = [d if k else None for d, k in zip(take("<i8", docs).tolist(), known.tolist(), strict=True)]
    lengths, sizes, coded, sums = take("<u4", docs), take("<u4", blocks), take("<u4", blocks), take("<u4", blocks)
    if len(frame) != end + 2 * int(sizes.sum()):
        raise FrameError("cut short, or longer than it says")
    words = [take("<u2", n) for n in sizes.tolist()]
    if any(zlib.crc32(w) != s for w, s in zip(words, coded.tolist(), strict=True)):
        raise FrameError("block")
    ids = decode_blocks(words, total, classes)
    raw = ids.astype("<u4")
    if int(lengths.sum()) != total or any(zlib.crc32(raw[k * BLOCK : (k + 1) * BLOCK]) != s for k, s in enumerate(sums.tolist())):
        raise FrameError("checksum")
    return doc_ids, lengths, ids

"""Gray levels of baseline JPEG scans: the luma component, by Huffman decoding and inverse cosine transforms in doubles.

Levels may differ by one from those of integer decoders. Progressive, arithmetic, 12-bit and four-component files, and those whose
components are not luma first, are refused.
"""

from __future__ import annotations

import struct

import numpy as np


class JpegError(ValueError):
    """The bytes are no JPEG that can be read here."""


def _zigzag() -> list[int]:
    """Places in a block of 8 x 8 in the order of its coefficients: by diagonals, in alternate directions."""
    cells = [(x + y, x if (x + y) % 2 == 0 else y, 8 * y + x) for y in range(8) for x in range(8)]
    return [at for *_, at in sorted(cells)]


ZIGZAG = _zigzag()


def _cosines() -> np.ndarray:
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)


class _Bits:
    """Bits of a scan between two restarts, stuffing taken out, ones after the end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def peek(self) -> int:
        while self.n < 16:
            self.held = (self.held << 8) | (self.data[self.at] if self.at < len(self.data) else 255)
            self.at += 1
            self.n += 8
            if self.at > len(self.data) + 64:
                raise JpegError("cut short")
        return (self.held >> (self.n - 16)) & 0xFFFF

    def drop(self, k: int) -> None:
        self.n -= k
        self.held &= (1 << self.n) - 1

    def symbol(self, table: list) -> int:
        length, value = table[self.peek()]
        if not length:
            raise JpegError("no such code")
        self.drop(length)
        return value

    def number(self, size: int) -> int:
        """A signed number of so many bits."""
        if not size:
            return 0
        v = self.peek() >> (16 - size)
        self.drop(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


def _codes(counts: bytes, values: bytes) -> list:
    """For each 16 bits, the length of the code that they begin with and its value."""
    table, code, at = [(0, 0)] * (1 << 16), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            first = code << (16 - length)
            if at >= len(values) or first >= 1 << 16:
                raise JpegError("bad code table")
            table[first : first + (1 << (16 - length))] = [(length, values[at])] * (1 << (16 - length))
            code, at = code + 1, at + 1
        code <<= 1
    return table


def decode(data: bytes, most: int) -> np.ndarray:
    """Gray levels; `most` bounds the declared pixels before anything is allocated."""
    quant: dict[int, np.ndarray] = {}
    codes: dict[int, list] = {}
    frame, restart, at = None, 0, 2
    try:
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            if data[at] != 0xFF:
                raise JpegError("no marker")
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide, own = body[k] >> 4, body[k] & 15
                    raw = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.float64)
                    quant[own] = np.zeros(64)
                    quant[own][ZIGZAG] = raw
                    k += 1 + 64 * (2 if wide else 1)
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    n = sum(body[k + 1 : k + 17])
                    codes[body[k]] = _codes(body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                    k += 17 + n
            elif marker in (0xC0, 0xC1):
                depth, height, width, parts = struct.unpack_from(">BHHB", body)
                if depth != 8 or parts not in (1, 3) or not height or not width:
                    raise JpegError("unsupported frame")
                if height * width > most:
                    raise JpegError("too large")
                frame = (height, width, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(parts)])
            elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
                raise JpegError("not baseline")
            elif marker == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif marker == 0xEE and body[:5] == b"Adobe" and body[11] == 0 and frame and len(frame[2]) == 3:
                raise JpegError("components are no luma")
            elif marker == 0xDA:
                if frame is None or body[0] != len(frame[2]):
                    raise JpegError("unsupported scan")
                chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                return _scan(data, at, frame, [chosen[c] for c, *_ in frame[2]], quant, codes, restart)
    except (IndexError, KeyError, struct.error, ValueError) as e:
        raise JpegError(str(e)) from e


def _segments(data: bytes, at: int) -> list[bytes]:
    """The scan's bytes between restarts, without stuffing."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise JpegError("no end")
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at])
            at = start = at + 2
        else:
            out.append(data[start:at])
            return [x.replace(b"\xff\x00", b"\xff") for x in out]


def _scan(data: bytes, at: int, frame: tuple, tables: list[int], quant: dict, codes: dict, restart: int) -> np.ndarray:
    height, width, parts = frame
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    if parts[0][1:3] != (across, down):
        raise JpegError("luma is not the finest component")
    if len(parts) == 1:
        across = down = 1
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    wide, high = -(-width // (8 * across)), -(-height // (8 * down))
    luma = np.zeros((high * down, wide * across, 64), np.int32)
    segments, before, bits, left = iter(_segments(data, at)), [0] * len(parts), None, 0
    for unit in range(wide * high):
        if bits is None or (restart and not left):
            bits, before, left = _Bits(next(segments, b"")), [0] * len(parts), restart
        left -= 1
        for i, (_, h, v, _) in enumerate(parts):
            dc, ac = codes[tables[i] >> 4], codes[0x10 | tables[i] & 15]
            for piece in range(h * v):
                before[i] += bits.number(bits.symbol(dc))
                found = [(0, before[i])]
                k = 1
                while k < 64:
                    s = bits.symbol(ac)
                    if s & 15:
                        k += s >> 4
                        found.append((ZIGZAG[k], bits.number(s & 15)))
                        k += 1
                    elif s == 0xF0:
                        k += 16
                    else:
                        break
                if i == 0:
                    block = luma[unit // wide * v + piece // h, unit % wide * h + piece % h]
                    for place, value in found:
                        block[place] = value
    c = _cosines()
    cells = (luma * quant[parts[0][3]]).reshape(*luma.shape[:2], 8, 8)
    levels = np.einsum("ky,abkl,lx->abyx", c, cells, c, optimize=True) + 128
    whole = np.clip(np.floor(levels + 0.5), 0, 255).astype(np.uint8).swapaxes(1, 2).reshape(luma.shape[0] * 8, luma.shape[1] * 8)
    return whole[:height, :width]


def exif(data: bytes) -> bytes | None:
    """The Exif block of a JPEG."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack_from(">H", data, at + 2)[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    return None

"""Scans: decoding to 8-bit gray, foreground, margins and ink bands."""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field
from statistics import median

import numpy as np

from . import jpeg

Box = tuple[int, int, int, int]
#: Weights of red, green and blue in 16-bit fixed point.
LUMA = (19595, 38470, 7471)


class ScanError(ValueError):
    """The bytes are no scan that can be read."""


#: Declared pixels beyond which a scan is refused before anything is allocated.
MAX_PIXELS = (1 << 30) // 12


def _sized(width: int, height: int) -> None:
    if width < 1 or height < 1:
        raise ScanError("bad dimensions")
    if width * height > MAX_PIXELS:
        raise ScanError("too large")


def _netpbm(data: bytes) -> np.ndarray:
    head = re.match(rb"P([1245])((?:\s*#[^\n]*\n|\s)+)", data)
    if not head:
        raise ScanError("unknown netpbm kind")
    kind, at, numbers = int(head[1]), len(head[0]), []
    while len(numbers) < (2 if kind in (1, 4) else 3):
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if not m:
            raise ScanError("cut short")
        numbers.append(int(m[1]))
        at = m.end()
    width, height, top = *numbers[:2], numbers[2] if kind in (2, 5) else 1
    if not 0 < top < 256:
        raise ScanError("bad depth")
    _sized(width, height)
    body = data[at:]
    if kind in (1, 2):
        body = re.sub(rb"#[^\n]*", b"", body)
        values = np.frombuffer(b"".join(body.split()), np.uint8) - 48 if kind == 1 else np.array(body.split(), np.int64)
        values = values[: width * height]
    elif kind == 4:
        stride = -(-width // 8)
        raw = np.frombuffer(body[1 : 1 + stride * height], np.uint8)
        if raw.size < stride * height:
            raise ScanError("cut short")
        values = np.unpackbits(raw.reshape(height, stride), axis=1)[:, :width].ravel()
    else:
        values = np.frombuffer(body[1 : 1 + width * height], np.uint8)
    if values.size < width * height or (kind == 1 and values.size and values.max() > 1):
        raise ScanError("cut short")
    gray = values.reshape(height, width)
    return np.where(gray > 0, 0, 255).astype(np.uint8) if kind in (1, 4) else (gray.astype(np.int64) * 255 // top).astype(np.uint8)


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8)
    if rows.size < height * (stride + 1):
        raise ScanError("cut short")
    rows = rows[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)
    for y in range(height):
        kind, line, above = int(rows[y, 0]), rows[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            out[y + 1] = np.concatenate([np.cumsum(line[c::step], dtype=np.uint8)[:, None] for c in range(step)], axis=1).ravel()[:stride] if stride % step == 0 else line
        elif kind == 2:
            out[y + 1] = line + above
        elif kind in (3, 4):
            now, up, got = bytearray(stride), above.tolist(), line.tolist()
            for x in range(stride):
                a = now[x - step] if x >= step else 0
                b, c = up[x], up[x - step] if x >= step else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                now[x] = (got[x] + guess) & 255
            out[y + 1] = np.frombuffer(now, np.uint8)
        else:
            raise ScanError("unknown filter")
    return out[1:]


def luma(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., k].astype(np.int64) for k in range(3))
    return ((r * LUMA[0] + g * LUMA[1] + b * LUMA[2] + 0x8000) >> 16).astype(np.uint8)


#: First column and row of each pass of an interlaced PNG, and its steps.
ADAM7 = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def _inflated(data: bytes, size: int) -> bytes:
    """`size` decompressed bytes; a stream that holds more gives no more."""
    try:
        raw = zlib.decompressobj().decompress(data, size)
    except zlib.error as e:
        raise ScanError("damaged png") from e
    if len(raw) < size:
        raise ScanError("cut short")
    return raw


def _png(data: bytes) -> np.ndarray:
    at, parts, palette, alpha, head = 8, [], None, None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = body
        elif kind == b"IDAT":
            parts.append(body)
        at += size + 12
    if head is None:
        raise ScanError("no header")
    width, height, depth, kind, _, _, interlace = head
    _sized(width, height)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if channels is None or depth not in (1, 2, 4, 8, 16) or interlace > 1:
        raise ScanError("unsupported png")
    passes = [(x, y, dx, dy) for x, y, dx, dy in ADAM7 if x < width and y < height] if interlace else [(0, 0, 1, 1)]
    sizes = [(-(-(height - y) // dy), -(-(width - x) // dx)) for x, y, dx, dy in passes]
    strides = [-(-w * channels * depth // 8) for _, w in sizes]
    raw = _inflated(b"".join(parts), sum(h * (n + 1) for (h, _), n in zip(sizes, strides, strict=True)))
    pixels, at = np.zeros((height, width, channels), np.uint8), 0
    for (x, y, dx, dy), (h, w), stride in zip(passes, sizes, strides, strict=True):
        rows = _unfilter(raw[at : at + h * (stride + 1)], h, stride, max(1, channels * depth // 8))
        at += h * (stride + 1)
        if depth == 16:  # the high byte
            rows = rows[:, ::2]
        elif depth < 8:
            bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
            rows = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2)[:, :w].astype(np.uint8)
            rows = rows if kind == 3 else (rows.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
        pixels[y::dy, x::dx] = rows.reshape(h, w, channels)
    opacity = pixels[..., -1].astype(np.int64) if kind in (4, 6) else None
    if kind == 3:
        if palette is None:
            raise ScanError("no palette")
        opacity = np.array([*(alpha or b""), *[255] * 256], np.int64)[pixels[..., 0]] if alpha else None
        pixels = palette[np.minimum(pixels[..., 0], len(palette) - 1)]
    colour = pixels[..., :3] if pixels.shape[2] >= 3 else pixels[..., :1]
    if opacity is not None:  # over white
        a = opacity[..., None]
        colour = ((colour.astype(np.int64) * a + 255 * (255 - a) + 127) // 255).astype(np.uint8)
    return luma(colour) if colour.shape[2] == 3 else colour[..., 0]


def _tag(block: bytes | None) -> int | None:
    """The orientation that an Exif block tells, 1 to 8."""
    try:
        order = {b"II": "<", b"MM": ">"}[block[:2]]
        start = struct.unpack_from(order + "I", block, 4)[0]
        for k in range(struct.unpack_from(order + "H", block, start)[0]):
            tag, kind, _, value = struct.unpack_from(order + "HHIH", block, start + 2 + 12 * k)
            if tag == 0x0112 and kind == 3:
                return value if 1 <= value <= 8 else None
    except (KeyError, TypeError, struct.error):
        pass
    return None


def orientation(data: bytes) -> int | None:
    """The Exif orientation that a scan records; it is told, not applied."""
    if data[:3] == b"\xff\xd8\xff":
        return _tag(jpeg.exif(data))
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size, kind = struct.unpack_from(">I4s", data, at)
            if kind == b"eXIf":
                return _tag(data[at + 8 : at + 8 + size])
            at += size + 12
    return None


def decode(data: bytes) -> np.ndarray:
    """8-bit gray of a plain or raw netpbm bitmap or graymap, a PNG of any depth, interlaced or not, or a baseline JPEG; transparency
    lies over white. A scan of over MAX_PIXELS is refused by its header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:3] == b"\xff\xd8\xff":
        try:
            return jpeg.decode(data, MAX_PIXELS)
        except jpeg.JpegError as e:
            raise ScanError(str(e)) from e
    if data[:1] == b"P":
        return _netpbm(data)
    raise ScanError("no codec for these bytes")


def otsu(gray: np.ndarray) -> int:
    """The lowest level that maximises the variance between classes, in whole numbers of any size; 0 if there is none."""
    counts = [int(c) for c in np.bincount(gray.ravel(), minlength=256)]
    total, weight = sum(counts), sum(level * c for level, c in enumerate(counts))
    best, n, s = (0, 0, 1), 0, 0
    for level, c in enumerate(counts):
        n, s = n + c, s + level * c
        between = (n * weight - total * s) ** 2
        spread = n * (total - n)
        if spread and between * best[2] > best[1] * spread:
            best = (level, between, spread)
    return best[0]


def span(flags: np.ndarray) -> tuple[int, int] | None:
    """First and last-plus-one true position."""
    at = np.flatnonzero(flags)
    return (int(at[0]), int(at[-1]) + 1) if at.size else None


def bounds_of(mask: np.ndarray) -> Box | None:
    y, x = span(mask.any(axis=1)), span(mask.any(axis=0))
    return (x[0], y[0], x[1], y[1]) if x and y else None


def stretches(flags: np.ndarray, bridge: int = 0) -> list[tuple[int, int]]:
    """Half-open ranges of true positions, joined over at most `bridge` false ones."""
    at = np.flatnonzero(flags)
    if not at.size:
        return []
    cut = np.flatnonzero(np.diff(at) > bridge + 1)
    return list(zip(at[np.r_[0, cut + 1]].tolist(), (at[np.r_[cut, at.size - 1]] + 1).tolist(), strict=True))


def ink_bands(mask: np.ndarray) -> list[dict]:
    """Rows with enough ink, joined over one weak row, of two rows at least."""
    box = bounds_of(mask)
    if box is None:
        return []
    enough = max(2, -(-(box[2] - box[0]) // 200))
    out = []
    for top, bottom in stretches(mask.sum(axis=1) >= enough, bridge=1):
        part = mask[top:bottom]
        x = span(part.any(axis=0))
        if bottom - top >= 2 and x:
            out.append({"y_start": top, "y_end": bottom, "x_start": x[0], "x_end": x[1], "foreground_pixels": int(part.sum())})
    return out


def _dense(strip: np.ndarray) -> bool:
    return strip.size > 0 and 2 * int(strip.sum()) >= strip.size


@dataclass
class Measurement:
    width: int
    height: int
    threshold: int
    bounds: Box | None
    foreground_pixels: int
    bands: list[dict]
    margins: Box | None = None
    band_height: float | None = None
    band_pitch: float | None = None
    diagnostics: list[str] = field(default_factory=list)


def measure(gray: np.ndarray) -> tuple[Measurement, np.ndarray]:
    """The page's measurement and its ink mask."""
    height, width = gray.shape
    threshold = otsu(gray)
    mask = gray <= threshold
    bands, box, ink = ink_bands(mask), bounds_of(mask), int(mask.sum())
    found = Measurement(width, height, threshold, box, ink, bands)
    if box:
        found.margins = (box[0], box[1], width - box[2], height - box[3])
    tops = [b["y_start"] for b in bands]
    if bands:
        found.band_height = float(median(b["y_end"] - b["y_start"] for b in bands))
    if len(bands) > 1:
        found.band_pitch = float(median(b - a for a, b in zip(tops, tops[1:], strict=False)))
    if not ink:
        found.diagnostics.append("blank")
    elif len(bands) == 1:
        found.diagnostics.append("one_band")
    rows, cols = max(1, -(-height // 100)), max(1, -(-width // 100))
    if (_dense(mask[:rows]) and _dense(mask[height - rows :])) or (_dense(mask[:, :cols]) and _dense(mask[:, width - cols :])):
        found.diagnostics.append("border_dominated")
    if ink * 100 > mask.size * 60:
        found.diagnostics.append("high_foreground_ratio")
    return found, mask


def write_png(gray: np.ndarray) -> bytes:
    """An 8-bit gray PNG."""
    height, width = gray.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), gray.astype(np.uint8)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")

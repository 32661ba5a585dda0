"""Review overlays: a page's candidates by match state, and a line with its baseline and x-height."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .raster import Box

#: Colours of an accepted match, a match on a page not accepted, a skipped candidate, the two rules and a line's box.
ACCEPTED, PROPOSED, SKIPPED = (0, 192, 0), (224, 160, 0), (224, 0, 0)
BASELINE, X_HEIGHT, LINE_BOX = (0, 96, 255), (224, 0, 192), (128, 128, 128)
MARGIN = 8


def png_rgb(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def _outline(pixels: np.ndarray, box: Box, colour: tuple[int, int, int]) -> None:
    x0, y0, x1, y1 = box
    pixels[[y0, y1 - 1], x0:x1] = colour
    pixels[y0:y1, [x0, x1 - 1]] = colour


def page_overlay(gray: np.ndarray, boxes: list[Box], matched: set[int], accepted: bool) -> bytes:
    """The page with each candidate's box in the colour of its state."""
    pixels = np.repeat(gray[..., None], 3, axis=2)
    for i, box in enumerate(boxes):
        _outline(pixels, box, (ACCEPTED if accepted else PROPOSED) if i in matched else SKIPPED)
    return png_rgb(pixels)


def line_overlay(gray: np.ndarray, box: Box, baseline: int, x_height_top: int, margin: int = MARGIN) -> bytes:
    """A line's crop, grown by the margin within the page, with both rules across its whole width."""
    left, top = max(0, box[0] - margin), max(0, box[1] - margin)
    crop = np.repeat(gray[top : box[3] + margin, left : box[2] + margin, None], 3, axis=2)
    _outline(crop, (box[0] - left, box[1] - top, box[2] - left, box[3] - top), LINE_BOX)
    for row, colour in ((baseline, BASELINE), (x_height_top, X_HEIGHT)):
        if 0 <= row - top < crop.shape[0]:
            crop[row - top] = colour
    return png_rgb(crop)

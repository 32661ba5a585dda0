"""Typography of a matched line and the characters of a word, from the ink mask."""

from __future__ import annotations

import math
from statistics import median

import numpy as np

from .raster import Box, bounds_of, span, stretches

#: Fixed values.
SEGMENT_MIN, SEGMENT_SHARE, SEGMENTS_MIN = 200, 8, 3
SKEW_MAX = 0.02


def segments(width: int) -> list[tuple[int, int]]:
    """Column ranges of a line; a last one under half a segment is part of the one before."""
    step = max(SEGMENT_MIN, width // SEGMENT_SHARE)
    cuts = [*range(0, width, step), width]
    if len(cuts) > 2 and (cuts[-1] - cuts[-2]) * 2 < step:
        del cuts[-2]
    return list(zip(cuts, cuts[1:], strict=False))


def _rows(part: np.ndarray) -> tuple[int, int] | None:
    """(baseline, x-height top): the sharpest drop in the lower half of the inked rows, the sharpest rise in the upper."""
    ink = part.sum(axis=1).astype(np.int64)
    rows = span(ink > 0)
    if rows is None:
        return None
    top, bottom = rows[0], rows[1] - 1
    middle = (top + bottom) // 2
    step = np.diff(ink)
    if not top < middle < bottom:
        return None
    drop = int(np.argmax(-step[middle:bottom]))
    rise = int(np.argmax(step[top:middle]))
    if step[middle + drop] >= 0 or step[top + rise] <= 0:
        return None
    return middle + drop, top + rise + 1


def measure_line(mask: np.ndarray, box: Box) -> dict:
    """Baseline, x-height, stroke and skew of a line, or the reason why it has none."""
    x0, y0, x1, y1 = box
    line = mask[y0:y1, x0:x1]
    found = [((a + b) / 2, *rows) for a, b in segments(x1 - x0) if (rows := _rows(line[:, a:b]))]
    if len(found) < SEGMENTS_MIN:
        return {"measured": False, "reason": "insufficient_segments", "segments": len(found)}
    mx, my = sum(f[0] for f in found) / len(found), sum(f[1] for f in found) / len(found)
    under = sum((f[0] - mx) ** 2 for f in found)
    slope = sum((f[0] - mx) * (f[1] - my) for f in found) / under if under else 0.0
    if abs(slope) > SKEW_MAX:
        return {"measured": False, "reason": "skew_exceeds_maximum", "segments": len(found), "skew_slope": slope}
    base, top = (math.floor(median(f[k] for f in found) + 0.5) for k in (1, 2))
    between = line[min(base, top) : max(base, top) + 1]
    edge = np.diff(np.pad(between, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    lengths = np.nonzero(edge == -1)[1] - np.nonzero(edge == 1)[1]
    return {
        "measured": True, "segments": len(found), "skew_slope": slope, "baseline_row_px": y0 + base, "x_height_top_row_px": y0 + top, "x_height_px": base - top,
        "ascender_extent_px": base, "descender_extent_px": y1 - y0 - base, "stroke_width_px": float(np.median(lengths)) if lengths.size else 0.0,
    }


def _tight(mask: np.ndarray, box: Box, columns: tuple[int, int]) -> Box:
    x0, y0, _, y1 = box
    a, b = x0 + columns[0], x0 + columns[1]
    top, bottom = span(mask[y0:y1, a:b].any(axis=1))
    return a, y0 + top, b, y0 + bottom


def measure_words(mask: np.ndarray, box: Box, profile: list[float], text: str, gap: int) -> dict:
    """Word runs of a line, the first one's columns on the line's rows, and a box for each word where there are as many runs as words."""
    runs = stretches(np.array(profile) > 0, bridge=gap - 1)
    words = len(text.split())
    boxes = [_tight(mask, box, r) for r in runs] if len(runs) == words else []
    first = (box[0] + runs[0][0], box[1], box[0] + runs[0][1], box[3]) if runs and words else None
    return {"word_run_count": len(runs), "source_word_count": words, "words_reconciled": len(runs) == words, "boxes": boxes, "first_run": first}


def cut_word(mask: np.ndarray, box: Box, text: str) -> dict:
    """The characters of a word: its ink runs between blank columns, bound in order to its printing characters."""
    x0, y0, x1, y1 = box
    printing = [c for c in text if not c.isspace()]
    runs = stretches(mask[y0:y1, x0:x1].any(axis=0)) if x1 > x0 and y1 > y0 else []
    reason = None
    if not any(c.isalnum() for c in text):
        reason = "no_labelled_letters"
    elif not runs:
        reason = "no_ink"
    elif len(runs) != len(printing):
        reason = "run_count_disagrees"
    glyphs = [] if reason else [(c, i, _tight(mask, box, r)) for i, (c, r) in enumerate(zip(printing, runs, strict=True)) if c.isalnum()]
    return {"run_count": len(runs), "position_count": len(printing), "reason": reason, "glyphs": glyphs}


def crop_to_ink(mask: np.ndarray, box: Box) -> Box | None:
    x0, y0, x1, y1 = box
    inner = bounds_of(mask[y0:y1, x0:x1]) if x1 > x0 and y1 > y0 else None
    return (x0 + inner[0], y0 + inner[1], x0 + inner[2], y0 + inner[3]) if inner else None


#: Bits behind the point of a resize weight.
_FINE = 22


def _triangles(n: int, m: int) -> np.ndarray:
    """Weights, in whole numbers, of n cells in each of m: triangles as wide as a new cell, at least as an old one."""
    scale = n / m
    reach = max(scale, 1.0)
    w = np.zeros((m, n))
    for k in range(m):
        center = (k + 0.5) * scale
        a, b = max(int(center - reach + 0.5), 0), min(int(center + reach + 0.5), n)
        part = np.maximum(0.0, 1 - np.abs((np.arange(a, b) - center + 0.5) / reach))
        w[k, a:b] = part / part.sum()
    return np.floor(w * (1 << _FINE) + 0.5).astype(np.int64)


def shape(gray: np.ndarray, rows: int = 16, columns: int = 12) -> np.ndarray:
    """A glyph as an inverted grid of mean ink: resized along rows, rounded to whole levels, then along columns and rounded again."""
    if not gray.size:
        return np.zeros((rows, columns), np.uint8)
    rounded = lambda x: np.clip((x + (1 << (_FINE - 1))) >> _FINE, 0, 255)
    wide = rounded(gray.astype(np.int64) @ _triangles(gray.shape[1], columns).T)
    return (255 - rounded(_triangles(gray.shape[0], rows) @ wide)).astype(np.uint8)


def shape_reference(grids: list[np.ndarray], least: int = 60, most: int = 250) -> dict | None:
    """Median grid and 95 % scatter of the first grids of a character."""
    if len(grids) < least:
        return None
    some = np.stack(grids[:most]).astype(np.float32)
    center = np.median(some, axis=0)
    away = sorted(_distance(g, center) for g in some)
    return {"grid": center.astype(np.uint8), "scatter": away[min(len(away) - 1, int(0.95 * len(away)))]}


def _distance(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.sqrt(((a.astype(np.float32) - b.astype(np.float32)) ** 2).sum()) / 255.0)


def shape_distance(grid: np.ndarray, reference: dict) -> float:
    return _distance(grid, reference["grid"])


def unlike(grid: np.ndarray, reference: dict, ratio: float = 1.4) -> bool:
    return reference["scatter"] > 0 and shape_distance(grid, reference) > ratio * reference["scatter"]


def mask_fault(mask: np.ndarray, matched: list[tuple[int, Box, int, list[float]]]) -> tuple[str, int] | None:
    """The first candidate (ordinal, box, ink, profile) that the mask does not reproduce exactly, with the reason."""
    for ordinal, (x0, y0, x1, y1), ink, profile in matched:
        columns = mask[y0:y1, x0:x1].sum(axis=0).tolist()
        found = sum(columns)
        if found != ink:
            return "foreground_pixels_mismatch", ordinal
        if profile is not None and [c / found for c in columns] != list(profile):
            return "horizontal_ink_profile_mismatch", ordinal
    return None


def clipped(box: Box, mask: np.ndarray) -> Box | None:
    """A box within the page; None if none of it is."""
    x0, y0, x1, y1 = max(0, box[0]), max(0, box[1]), min(mask.shape[1], box[2]), min(mask.shape[0], box[3])
    return (x0, y0, x1, y1) if x0 < x1 and y0 < y1 else None


def atlas_sheet(crops: list[np.ndarray], width: int, height: int, columns: int = 32, gutter: int = 160, paper: int = 255) -> np.ndarray:
    """Crops in cells with a one-pixel gutter, each centred, the middle of larger ones."""
    rows = -(-len(crops) // columns)
    sheet = np.full((rows * (height + 1) + 1, columns * (width + 1) + 1), gutter, np.uint8)
    for i, crop in enumerate(crops):
        y, x = (i // columns) * (height + 1) + 1, (i % columns) * (width + 1) + 1
        cell = np.full((height, width), paper, np.uint8)
        h, w = min(height, crop.shape[0]), min(width, crop.shape[1])
        cy, cx, sy, sx = (height - h) // 2, (width - w) // 2, (crop.shape[0] - h) // 2, (crop.shape[1] - w) // 2
        cell[cy : cy + h, cx : cx + w] = crop[sy : sy + h, sx : sx + w]
        sheet[y : y + height, x : x + width] = cell
    return sheet

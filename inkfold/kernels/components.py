"""Connected ink and line candidates of a page."""

from __future__ import annotations

from dataclasses import dataclass
from statistics import median

import numpy as np

from .raster import Box, stretches

#: Fixed values, in percent where not said otherwise.
BORDER_EDGES = 3
RULE_WIDTH, RULE_HEIGHT = 80, 2
JOIN_OVERLAP, JOIN_CENTER_TENTHS, JOIN_GAP_HEIGHTS = 40, 12, 2
MINOR_INK, FRAGMENTED_RATE = 2, 35
SPECK_INK, SPECK_HEIGHT = 5, 31
BAND_RULE_HEIGHT, BAND_RULE_DENSITY = 50, 60
GUTTER_WIDTH, GUTTER_COVER_TENTHS = 3, 6


@dataclass(frozen=True, order=True)
class Blob:
    """Ink with its box; `first` is the smallest ordinal of the components in it."""

    box: Box
    first: int
    count: int
    ink: int

    @property
    def height(self) -> int:
        return self.box[3] - self.box[1]


def union(blobs: list[Blob]) -> Blob:
    x0, y0, x1, y1 = zip(*(b.box for b in blobs), strict=True)
    return Blob((min(x0), min(y0), max(x1), max(y1)), min(b.first for b in blobs), sum(b.count for b in blobs), sum(b.ink for b in blobs))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of n items' groups, linked by pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            return root


def labelled(mask: np.ndarray) -> tuple[list[Blob], np.ndarray, np.ndarray]:
    """Components in order of their boxes, the mask's runs (y, start, stop), and each run's component.

    Runs of neighbouring rows touch, diagonals included, when neither ends before the other begins.
    """
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    y, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    n = len(y)
    if not n:
        return [], np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    wide = mask.shape[1] + 2
    # For each run, the runs of the row above with stop >= start and start <= stop are a stretch of the run list.
    low = np.searchsorted(y * wide + stop, (y - 1) * wide + start, "left")
    high = np.searchsorted(y * wide + start, (y - 1) * wide + stop, "right")
    size = np.maximum(high - low, 0)
    this = np.repeat(np.arange(n), size)
    above = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
    root = _roots(n, this, above)
    ids, label = np.unique(root, return_inverse=True)
    k = len(ids)
    box = np.empty((k, 4), np.int64)
    box[:, :2], box[:, 2:] = np.iinfo(np.int64).max, -1
    for col, values, pick in ((0, start, np.minimum), (1, y, np.minimum), (2, stop, np.maximum), (3, y + 1, np.maximum)):
        pick.at(box[:, col], label, values)
    ink = np.bincount(label, weights=stop - start, minlength=k).astype(np.int64)
    order = np.lexsort((np.arange(k), box[:, 3], box[:, 2], box[:, 1], box[:, 0]))
    place = np.empty(k, np.int64)
    place[order] = np.arange(k)
    blobs = [Blob(tuple(box[i].tolist()), o, 1, int(ink[i])) for o, i in enumerate(order.tolist())]
    return blobs, np.stack([y, start, stop], axis=1), place[label]


def _cleared(mask: np.ndarray, runs: np.ndarray, label: np.ndarray, gone: list[int]) -> None:
    for y, a, b in runs[np.isin(label, gone)].tolist():
        mask[y, a:b] = False


def clean_mask(mask: np.ndarray, bounds: Box) -> tuple[np.ndarray, list[tuple[str, Blob]]]:
    """The mask without page borders and page-wide rules, and what was taken away."""
    mask, rejected = mask.copy(), []
    height, width = mask.shape
    for reason, hit in (
        ("page_border", lambda b: (b.box[0] == 0) + (b.box[1] == 0) + (b.box[2] == width) + (b.box[3] == height) >= BORDER_EDGES),
        ("long_horizontal_rule", lambda b: (b.box[2] - b.box[0]) * 100 > (bounds[2] - bounds[0]) * RULE_WIDTH and b.height * 100 < (bounds[3] - bounds[1]) * RULE_HEIGHT),
    ):
        blobs, runs, label = labelled(mask)
        gone = [i for i, b in enumerate(blobs) if hit(b)]
        rejected += [(reason, blobs[i]) for i in gone]
        if gone:
            _cleared(mask, runs, label, gone)
    return mask, rejected


def _linked_roots(blobs: list[Blob], linked, beyond) -> list[int]:
    """For each of blobs in order, the first of those linked with it directly or through others; `beyond` says that no later blob can be linked."""
    a, b = [], []
    for i, left in enumerate(blobs):
        for j in range(i + 1, len(blobs)):
            if beyond(left, blobs[j]):
                break
            if linked(left, blobs[j]):
                a.append(i)
                b.append(j)
    return _roots(len(blobs), np.array(a, np.int64), np.array(b, np.int64)).tolist() if a else list(range(len(blobs)))


def _grouped(blobs: list[Blob], linked, beyond) -> list[Blob]:
    """Unions of blobs linked directly or through others."""
    blobs = sorted(blobs)
    root = _linked_roots(blobs, linked, beyond)
    return sorted(union([x for x, r in zip(blobs, root, strict=True) if r == g]) for g in sorted(set(root)))


def joinable(blobs: list[Blob]) -> tuple:
    """(linked, beyond) for components side by side: two fifths of the lower one's height shared, centres apart by three fifths of the
    taller one's at most, and a gap of twice the median height at most."""
    most = JOIN_GAP_HEIGHTS * median(b.height for b in blobs)

    def near(a: Blob, b: Blob) -> bool:
        shared = max(0, min(a.box[3], b.box[3]) - max(a.box[1], b.box[1]))
        apart = abs(a.box[1] + a.box[3] - b.box[1] - b.box[3])
        gap = max(0, b.box[0] - a.box[2], a.box[0] - b.box[2])
        return shared * 100 >= min(a.height, b.height) * JOIN_OVERLAP and apart * 10 <= max(a.height, b.height) * JOIN_CENTER_TENTHS and gap <= most

    return near, lambda a, b: b.box[0] - a.box[2] > most


def joined_roots(blobs: list[Blob]) -> list[int]:
    """A number for each blob, the same for those joined."""
    order = sorted(range(len(blobs)), key=lambda i: blobs[i])
    root = _linked_roots([blobs[i] for i in order], *joinable(blobs)) if blobs else []
    out = [0] * len(blobs)
    for i, r in zip(order, root, strict=True):
        out[i] = r
    return out


def clusters(blobs: list[Blob]) -> list[Blob]:
    """Components of a band joined into visual pieces: side by side at one height, then by overlap of their columns."""
    joined = _grouped(blobs, *joinable(blobs))
    return _grouped(joined, lambda a, b: True, lambda a, b: b.box[0] >= a.box[2])


def _minor_split(found: list[Blob]) -> tuple[list[Blob], list[Blob]]:
    total = sum(b.ink for b in found)
    counted = [b for b in found if b.ink * 100 >= total * MINOR_INK]
    return (counted, [b for b in found if b not in counted]) if counted and total else (found, [])


def _band_reason(counted: list[Blob], ink_mid: float, height_mid: float) -> str | None:
    whole = union(counted)
    ink, area = sum(b.ink for b in counted), (whole.box[2] - whole.box[0]) * whole.height
    low = height_mid <= 0 or whole.height * 100 <= height_mid * SPECK_HEIGHT
    if ink_mid > 0 and low and ink * 100 < ink_mid * SPECK_INK:
        return "speck_band"
    if height_mid > 0 and whole.height * 100 <= height_mid * BAND_RULE_HEIGHT and area > 0 and ink * 100 > area * BAND_RULE_DENSITY:
        return "rule_band"
    return None


def gutter(mask: np.ndarray, bounds: Box, found: list[Blob]) -> dict | None:
    """The widest inner stretch of columns that most inked rows leave blank."""
    if not found:
        return None
    top, bottom = min(b.box[1] for b in found), max(b.box[3] for b in found)
    inside = mask[top:bottom, bounds[0] : bounds[2]]
    rows = inside[inside.any(axis=1)]
    if not len(rows):
        return None
    width = inside.shape[1]
    blank = (len(rows) - rows.sum(axis=0)) * 10 >= len(rows) * GUTTER_COVER_TENTHS
    wide = [(a, b) for a, b in stretches(blank) if a > 0 and b < width and b - a >= -(-width * GUTTER_WIDTH // 100)]
    if not wide:
        return None
    a, b = min(wide, key=lambda r: (r[0] - r[1], r[0]))
    return {"box": (bounds[0] + a, top, bounds[0] + b, bottom), "cover": float((~inside[:, a:b]).sum() / ((bottom - top) * (b - a)))}


def candidates(mask: np.ndarray, bounds: Box | None, bands: list[tuple[int, int]], furniture: frozenset[int] = frozenset()) -> dict:
    """Line candidates of a page's ink: candidates, rejected, gutter and exclusions."""
    out = {"candidates": [], "rejected": [], "gutter": None, "exclusions": [], "mask": mask}
    if bounds is None:
        return out | {"exclusions": ["foreground_bounds_unavailable"]}
    if len(bands) < 2:
        return out | {"exclusions": ["insufficient_ink_bands"]}
    mask, stripped = clean_mask(mask, bounds)
    out["mask"] = mask
    rejected = [(reason, None, b) for reason, b in stripped]
    if not mask.any() and not stripped:
        return out | {"exclusions": ["blank_page"]}
    split: list[tuple[int, list[Blob], list[Blob]]] = []
    for ordinal, (top, bottom) in enumerate(bands):
        blobs = labelled(mask[top:bottom])[0]
        if not blobs:
            rejected.append(("empty_band", ordinal, Blob((bounds[0], top, bounds[0], bottom), 0, 0, 0)))
            continue
        blobs = [Blob((b.box[0], b.box[1] + top, b.box[2], b.box[3] + top), b.first, 1, b.ink) for b in blobs]
        split.append((ordinal, *_minor_split(clusters(blobs))))
    ink_mid = median(sum(b.ink for b in c) for _, c, _ in split) if split else 0
    height_mid = median(union(c).height for _, c, _ in split) if split else 0
    kept: list[Blob] = []
    measured = fragmented = 0
    for ordinal, counted, minor in split:
        reason = "running_head" if ordinal in furniture else _band_reason(counted, ink_mid, height_mid)
        if reason:
            rejected += [(reason, ordinal, b) for b in counted + minor]
            continue
        kept += counted
        rejected += [("minor_ink_cluster", ordinal, b) for b in minor]
        measured += 1
        if len(counted) != 1:
            fragmented += 1
            rejected += [("fragmented_band", ordinal, b) for b in counted]
        whole = union(counted)
        x0, y0, x1, y1 = whole.box
        columns = mask[y0:y1, x0:x1].sum(axis=0)
        ink = int(columns.sum())
        if ink:
            profile = [int(c) / ink for c in columns]
            out["candidates"].append({"band": ordinal, "box": whole.box, "first": whole.first, "count": whole.count, "ink": ink, "profile": profile})
    out["candidates"].sort(key=lambda c: (c["band"], c["box"], c["first"]))
    out["gutter"] = gutter(mask, bounds, kept)
    if fragmented * 100 > measured * FRAGMENTED_RATE:
        out["exclusions"].append("fragmented_band")
        out["candidates"] = []
    if out["gutter"]:
        out["exclusions"].append("probable_multi_column")
    out["rejected"] = sorted(((r, o, b.box, b.ink) for r, o, b in rejected), key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2]))
    return out

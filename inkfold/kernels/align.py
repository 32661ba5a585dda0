"""Monotone alignment of source lines with line candidates, keeping the two best paths of every cell."""

from __future__ import annotations

from dataclasses import dataclass
from statistics import median

#: Fixed values.
SKIP = 1.0
STYLED_HEIGHT = 1.10
KINDS = ("match", "skip_image", "skip_text")


@dataclass(frozen=True)
class TextLine:
    ordinal: int
    text: str
    blank_before: int = 0
    styled: bool = False


def eligible_lines(lines: list[dict], styles: list[dict]) -> list[TextLine]:
    """Nonempty lines that may be matched, with the blank lines since the one before."""
    out: list[TextLine] = []
    blank = 0
    for line in lines:
        if not line["visible_text"]:
            blank += 1
        elif line["matching_eligible"]:
            styled = line["style_eligible"] and any(s["kind"] != "tb" and s["byte_start"] < line["content_end"] and line["byte_start"] < s["byte_end"] for s in styles)
            out.append(TextLine(line["ordinal"], line["visible_text"], blank if out else 0, styled))
            blank = 0
    return out


def match_parts(lines: list[TextLine], boxes: list[tuple[int, int, int, int]], bounds: tuple[int, int, int, int]) -> list[list[tuple[float, float, float, float]]]:
    """Costs of width, indent, gaps and style for each line and box."""
    wide = max((len(x.text) for x in lines), default=0) or 1
    lead = lambda t: len(t) - len(t.lstrip(" "))
    deep = max((lead(x.text) for x in lines), default=0) or 1
    span = (bounds[2] - bounds[0]) or 1
    gaps = [0] + [max(0, b[1] - a[3]) for a, b in zip(boxes, boxes[1:], strict=False)]
    gap = max(gaps, default=0) or 1
    tall = (median(b[3] - b[1] for b in boxes) if boxes else 0) or 1
    out = []
    for x in lines:
        row = []
        for box, before in zip(boxes, gaps, strict=False):
            width = abs(len(x.text) / wide - (box[2] - box[0]) / span)
            indent = abs(lead(x.text) / deep - (box[0] - bounds[0]) / span)
            gapped = abs(min(x.blank_before, 3) / 3 - min(max(before / gap, 0.0), 1.0))
            style = min(abs((box[3] - box[1]) / tall - (STYLED_HEIGHT if x.styled else 1.0)), 1.0)
            row.append((width, indent, gapped, style))
        out.append(row)
    return out


def total(parts: tuple[float, float, float, float]) -> float:
    return 0.55 * parts[0] + 0.25 * parts[1] + 0.15 * parts[2] + 0.05 * parts[3]


def best_paths(lines: list[TextLine], costs: list[list[float]], columns: int) -> list[tuple[float, tuple]]:
    """The two cheapest distinct paths, as (cost, operations); an operation is (kind, source + 1, candidate + 1), 0 for none.

    Equal costs are settled by the operations in order, match before skip_image before skip_text, then by ordinals; a path
    that begins another comes first. Costs add up along the path.
    """
    above: list[list[tuple[float, tuple]]] = []
    for r in range(len(lines) + 1):
        row: list[list[tuple[float, tuple]]] = []
        for c in range(columns + 1):
            if not r and not c:
                row.append([(0.0, ())])
                continue
            steps = []
            if r and c:
                steps += [(p[0] + costs[r - 1][c - 1], (*p[1], (0, lines[r - 1].ordinal + 1, c))) for p in above[c - 1]]
            if c:
                steps += [(p[0] + SKIP, (*p[1], (1, 0, c))) for p in row[c - 1]]
            if r:
                steps += [(p[0] + SKIP, (*p[1], (2, lines[r - 1].ordinal + 1, 0))) for p in above[c]]
            steps.sort()
            kept = steps[:1]
            kept += [s for s in steps[1:] if s[1] != kept[0][1]][:1]
            row.append(kept)
        above = row
    return above[columns]


def align(lines: list[TextLine], boxes: list[tuple[int, int, int, int]], bounds: tuple[int, int, int, int]) -> dict:
    """Operations, costs and uniqueness of the best path."""
    parts = match_parts(lines, boxes, bounds)
    paths = best_paths(lines, [[total(p) for p in row] for row in parts], len(boxes))
    place = {x.ordinal: i for i, x in enumerate(lines)}
    ops = []
    for kind, s, c in paths[0][1]:
        cost = parts[place[s - 1]][c - 1] if kind == 0 else None
        ops.append({"kind": KINDS[kind], "source": s - 1 if s else None, "candidate": c - 1 if c else None, "cost": total(cost) if cost else SKIP, "parts": cost})
    matched = sum(o["kind"] == "match" for o in ops)
    return {
        "operations": ops,
        "total_cost": paths[0][0],
        "normalized_cost": paths[0][0] / max(len(lines), len(boxes), 1),
        "matched_ratio": matched / len(lines) if lines else 0.0,
        "uniqueness": abs(paths[1][0] - paths[0][0]) if len(paths) > 1 else 0.0,
    }


def skipped(lines: list[TextLine], columns: int) -> list[dict]:
    """Operations of a page that is not aligned: every candidate, then every line, skipped."""
    return [{"kind": "skip_image", "source": None, "candidate": c, "cost": SKIP, "parts": None} for c in range(columns)] + [
        {"kind": "skip_text", "source": x.ordinal, "candidate": None, "cost": SKIP, "parts": None} for x in lines
    ]

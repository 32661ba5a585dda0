"""Page kernels as table operators: a page is a row, and a row's failure is a row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.kernels import align as A
from inkfold.kernels import components as C
from inkfold.kernels import lines as L
from inkfold.kernels import overlay as O
from inkfold.kernels import raster as R
from inkfold.kernels import source as S
from inkfold.kernels.natural import natural_key

from . import review as V

BOX = "struct<x0:int,y0:int,x1:int,y1:int>"
LINE = "ordinal:int,byte_start:long,content_end:long,byte_end:long,original_text:string,visible_text:string,first_operation:int,operations:int,span_ids:array<string>,continued_ids:array<string>,matching_eligible:boolean,style_eligible:boolean"
STYLE = "kind:string,start:int,end:int,byte_start:long,byte_end:long"
SPAN = "opening_id:string,block_id:string,kind:string,byte_start:long,byte_end:long,closed:boolean"
TOKENS = f"""project_id string, page_name string, source_text string, feature_text string, blocks array<string>, visible_text string, lines array<struct<{LINE}>>,
operations array<struct<kind:string,byte_start:long,byte_end:long,output:string>>, styles array<struct<{STYLE}>>, spans array<struct<{SPAN}>>, diagnostics array<struct<code:string,byte_start:long,byte_end:long>>"""
MEASURED = f"""project_id string, page_name string, sha256 string, exif_orientation int, width int, height int, threshold int, bounds {BOX}, margins {BOX}, foreground_pixels long,
bands array<struct<y_start:int,y_end:int,x_start:int,x_end:int,foreground_pixels:long>>, band_height double, band_pitch double, diagnostics array<string>"""
CANDIDATE = f"band:int,box:{BOX},ink:long,components:int,profile:array<double>"
EXTRACTED = f"""project_id string, page_name string, sha256 string, bounds {BOX}, candidates array<struct<{CANDIDATE}>>,
rejected array<struct<reason:string,band:int,box:{BOX},ink:long>>, gutter {BOX}, exclusions array<string>, mask binary"""
ALIGNED = """project_id string, page_name string, state string, exclusions array<string>, total_cost double, normalized_cost double, matched_ratio double, uniqueness double,
operations array<struct<kind:string,source:int,candidate:int,cost:double,width:double,indent:double,gaps:double,style:double>>,
evidence array<struct<code:string,lines:array<int>>>"""
#: Exclusions by diagnostic of a measurement; any other one is told as inherited.
INHERITED = {
    "blank": "blank_page", "blank_page": "blank_page", "one_band": "insufficient_ink_bands", "no_bands": "insufficient_ink_bands", "border_dominated": "border_dominated",
    "foreground_bounds_unavailable": "foreground_bounds_unavailable", "high_foreground_ratio": "high_foreground_ratio", "image_decode_failed": "image_decode_failed", "image_missing": "image_missing", "image_unreadable": "image_unreadable",
}
#: Rows to a batch of pages with their scans.
PAGE_BATCH = 8


def _box(b) -> dict | None:
    return dict(zip(("x0", "y0", "x1", "y1"), (int(v) for v in b), strict=True)) if b is not None else None


def _tuple(b: dict | None) -> tuple | None:
    return (b["x0"], b["y0"], b["x1"], b["y1"]) if b else None


def inherited(diagnostics: list[str]) -> list[str]:
    """Exclusion codes of a page's diagnostics, each once, in order."""
    return list(dict.fromkeys(INHERITED.get(d, "inherited_profile_diagnostic") for d in diagnostics))


_MARKS = "project_id string, page_name string, size long, marks array<struct<char:int,start:long,mark:string>>"
_RANGES = "array<struct<a:long,b:long>>"
_BLOCKS = f"project_id string, page_name string, deleted array<int>, bad {_RANGES}, spans array<struct<{SPAN}>>, told array<struct<code:string,a:long,b:long>>"


def tokenized(pages: DataFrame) -> DataFrame:
    """pages(project_id, page_name, text) taken apart, blocks carried over the pages of a project in natural order.

    Only the places of block controls meet by project; what they come to is joined back, and texts are taken apart page by page.
    Pages equal in project and name are one, the one with the greatest text.
    """
    once = pages.groupBy("project_id", "page_name").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))

    def marks(x: dict) -> list[dict]:
        size, found = S.controls(x["text"])
        return [{"project_id": x["project_id"], "page_name": x["page_name"], "size": size, "marks": [{"char": c, "start": a, "mark": m} for c, a, m in found]}]

    def resolved(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {n: (n, int(size), [(m["char"], m["start"], m["mark"]) for m in found]) for n, size, found in zip(pdf["page_name"], pdf["size"], pdf["marks"], strict=True)}
        got = S.resolved_blocks([rows[n] for n in sorted(rows, key=natural_key)])
        pair = lambda r: {"a": r[0], "b": r[1]}
        out = [{"project_id": pdf["project_id"].iloc[0], "page_name": n, "deleted": r["deleted"], "bad": list(map(pair, r["bad"])), "spans": r["spans"], "told": [{"code": c, "a": a, "b": b} for c, a, b in r["told"]]} for n, r in got.items()]
        return pd.DataFrame(out, columns=["project_id", "page_name", "deleted", "bad", "spans", "told"])

    blocks = _per_page(once, _MARKS, marks).groupBy("project_id").applyInPandas(resolved, _BLOCKS)
    rows = once.join(blocks.withColumnsRenamed({"project_id": "_p", "page_name": "_n"}), F.col("project_id").eqNullSafe(F.col("_p")) & F.col("page_name").eqNullSafe(F.col("_n"))).drop("_p", "_n")

    def page(x: dict) -> list[dict]:
        own = {"deleted": x["deleted"], "bad": [(r["a"], r["b"]) for r in x["bad"]], "spans": x["spans"], "told": [(t["code"], t["a"], t["b"]) for t in x["told"]]}
        got = S.tokenize_page(x["page_name"], x["text"], own)
        return [{"project_id": x["project_id"], **got, **S.feature_page(got, x["text"])}]

    return _per_page(rows, TOKENS, page)


def _per_page(df: DataFrame, schema: str, page) -> DataFrame:
    """mapInArrow of a function from a row (dict) to a row or several."""
    spark = df.sparkSession
    kind = spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(kind)
        for b in batches:
            for at in range(0, b.num_rows, PAGE_BATCH):
                rows = [r for x in b.slice(at, PAGE_BATCH).to_pylist() for r in page(x)]
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    return df.mapInArrow(run, kind)


def measured(scans: DataFrame) -> DataFrame:
    """Geometry of scans(project_id, page_name, content); an unreadable scan is a row with a diagnostic and no values."""

    def page(x: dict) -> list[dict]:
        row = {"project_id": x["project_id"], "page_name": x["page_name"]}
        if x["content"] is None:
            return [row | {"diagnostics": ["image_missing"]}]
        row["sha256"] = hashlib.sha256(x["content"]).hexdigest()
        row["exif_orientation"] = R.orientation(x["content"])
        try:
            m, _ = R.measure(R.decode(x["content"]))
        except R.ScanError:
            return [row | {"diagnostics": ["image_decode_failed"]}]
        keys = ("width", "height", "threshold", "foreground_pixels", "bands", "band_height", "band_pitch", "diagnostics")
        return [row | {k: getattr(m, k) for k in keys} | {"bounds": _box(m.bounds), "margins": _box(m.margins)}]

    return _per_page(scans.select("project_id", "page_name", "content"), MEASURED, page)


def extracted(scans: DataFrame) -> DataFrame:
    """Line candidates of scans(project_id, page_name, content, furniture: ordinals or null), with the cleaned mask as bits."""

    def page(x: dict) -> list[dict]:
        row = {"project_id": x["project_id"], "page_name": x["page_name"], "candidates": [], "rejected": []}
        if x["content"] is None:
            return [row | {"exclusions": ["image_missing"]}]
        row["sha256"] = hashlib.sha256(x["content"]).hexdigest()
        try:
            m, mask = R.measure(R.decode(x["content"]))
        except R.ScanError:
            return [row | {"exclusions": ["image_decode_failed"]}]
        if m.diagnostics:
            return [row | {"exclusions": inherited(m.diagnostics), "bounds": _box(m.bounds)}]
        got = C.candidates(mask, m.bounds, [(b["y_start"], b["y_end"]) for b in m.bands], frozenset(x.get("furniture") or ()))
        return [
            row
            | {
                "bounds": _box(m.bounds),
                "candidates": [{"band": c["band"], "box": _box(c["box"]), "ink": c["ink"], "components": c["count"], "profile": c["profile"]} for c in got["candidates"]],
                "rejected": [{"reason": r, "band": o, "box": _box(b), "ink": i} for r, o, b, i in got["rejected"]],
                "gutter": _box(got["gutter"]["box"]) if got["gutter"] else None,
                "exclusions": got["exclusions"],
                "mask": np.packbits(got["mask"]).tobytes(),
            }
        ]

    src = scans.select("project_id", "page_name", "content", *(["furniture"] if "furniture" in scans.columns else []))
    return _per_page(src, EXTRACTED, page)


def aligned(tokens: DataFrame, candidates: DataFrame) -> DataFrame:
    """Alignment of tokenized pages with their candidates by project and page; a page without candidates is excluded.

    tokens needs table_like and illustration_or_ornament (operators.features) to exclude such pages; both default to false.
    """
    flags = [c for c in ("table_like", "illustration_or_ornament", "spans") if c in tokens.columns]
    left = tokens.select("project_id", "page_name", "lines", "styles", *flags)
    rows = left.join(candidates.select("project_id", "page_name", "bounds", "candidates", "gutter", F.col("exclusions").alias("_x")), ["project_id", "page_name"], "left")

    def page(x: dict) -> list[dict]:
        lines = A.eligible_lines(x["lines"], x["styles"])
        boxes = [_tuple(c["box"]) for c in x["candidates"] or []]
        early = list(x["_x"]) if x["_x"] is not None else ["profile_page_missing"]
        early += ["persistent_gutter"] if x["gutter"] else []
        evidence = S.feature_evidence(x, [k for k in ("table_like", "illustration_or_ornament") if x.get(k)])
        early += list(evidence)
        early += ["malformed_control"] if any(not r["matching_eligible"] for r in x["lines"]) else []
        n = len(lines)
        count = [V.LINE_COUNT] if not V.MIN_LINES <= n <= V.MAX_LINES else []
        count += [V.COUNT_DIFFERENCE] if abs(n - len(boxes)) > max(V.COUNT_DIFFERENCE_MIN, -(-n // 10)) else []
        if count or not x["bounds"]:
            ops = A.skipped(lines, len(boxes))
            cost = float(sum(o["cost"] for o in ops))
            got = {"operations": ops, "total_cost": cost, "normalized_cost": cost / max(n, len(boxes), 1), "matched_ratio": 0.0, "uniqueness": 0.0}
        else:
            got = A.align(lines, boxes, _tuple(x["bounds"]))
        late = [V.RATIO] if got["matched_ratio"] < V.MATCHED_RATIO_MIN else []
        late += [V.COST] if got["normalized_cost"] > V.COST_MAX else []
        late += [V.UNIQUENESS] if got["uniqueness"] < V.UNIQUENESS_MIN else []
        state = "excluded" if early or count else "proposed" if late else "accepted"
        parts = lambda o: dict(zip(("width", "indent", "gaps", "style"), o["parts"] or (None,) * 4, strict=True))
        ops = [{k: o[k] for k in ("kind", "source", "candidate", "cost")} | parts(o) for o in got["operations"]]
        codes = list(dict.fromkeys(early + count)) or late
        return [{"project_id": x["project_id"], "page_name": x["page_name"], "state": state, "exclusions": codes, **{k: got[k] for k in ("total_cost", "normalized_cost", "matched_ratio", "uniqueness")}, "operations": ops, "evidence": [{"code": c, "lines": at} for c, at in evidence.items()]}]

    return _per_page(rows, ALIGNED, page)


LINES = f"project_id string, page_name string, candidate int, text string, box {BOX}, measured boolean, reason string, segments int, baseline_row_px int, x_height_top_row_px int, x_height_px int, ascender_extent_px int, descender_extent_px int, stroke_width_px double, skew_slope double, word_run_count int, source_word_count int, words_reconciled boolean, words array<{BOX}>, first_run {BOX}, indent_px int, word_gaps array<int>"
_LINE_KEYS = ("baseline_row_px", "x_height_top_row_px", "x_height_px", "ascender_extent_px", "descender_extent_px", "stroke_width_px", "skew_slope", "segments")


def line_typography(pages: DataFrame) -> DataFrame:
    """Typography of the matched lines of pages(project_id, page_name, width, height, mask, matched: array of candidate, box,
    profile and text, with ink where the mask is to be checked, gap, text_left or none): a row a line.

    A mask that does not give a candidate's recorded ink and profile exactly leaves the page's lines unmeasured, with the reason.
    """

    def page(x: dict) -> list[dict]:
        mask = _mask(x)
        out = []
        fault = L.mask_fault(mask, [(m["candidate"], _tuple(m["box"]), m["ink"], m["profile"]) for m in x["matched"]]) if x["matched"] and "ink" in x["matched"][0] else None
        for m in x["matched"]:
            row = {"project_id": x["project_id"], "page_name": x["page_name"], "candidate": m["candidate"], "text": m["text"], "box": m["box"], "measured": False}
            if fault:  # this mask is not the one that the lines were found in
                out.append(row | {"reason": fault[0]})
                continue
            got = L.measure_line(mask, _tuple(m["box"]))
            row |= {"measured": got["measured"], "reason": got.get("reason")} | {k: got.get(k) for k in _LINE_KEYS}
            row["indent_px"] = m["box"]["x0"] - x["text_left"] if x.get("text_left") is not None else None
            if got["measured"]:
                gap = x["gap"] or max(2, int(0.25 * got["x_height_px"] + 0.5))
                words = L.measure_words(mask, _tuple(m["box"]), m["profile"], m["text"], gap)
                row |= {k: words[k] for k in ("word_run_count", "source_word_count", "words_reconciled")} | {"words": [_box(b) for b in words["boxes"]]}
                row["first_run"] = _box(words["first_run"])
                row["word_gaps"] = [b[0] - a[2] for a, b in zip(words["boxes"], words["boxes"][1:], strict=False)]
            out.append(row)
        return out

    return _per_page(pages, LINES, page)


GLYPHS = f"project_id string, page_name string, tier string, line int, word int, text string, glyph int, character string, box {BOX}, run_count int, position_count int, reason string, ink long, confidence double, image binary, grid array<int>"


def _mask(x: dict) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x["mask"], np.uint8), count=x["width"] * x["height"]).reshape(x["height"], x["width"]).astype(bool)


def cut_glyphs(pages: DataFrame) -> DataFrame:
    """Characters of pages(project_id, page_name, width, height, mask, words: array of line, word, text and box): a row a
    character, or one with the reason for a word that can't be cut.

    Optional columns: content (the scan; crops and shape grids are then of its gray levels, else of the mask), furniture (array
    of line, word, text, box and confidence: recognised words outside all lines, clipped to the page and to their ink) and
    sha256 with furniture_sha256 (furniture of another scan is left out, with the reason scan_changed).
    """
    extra = [c for c in ("content", "furniture", "sha256", "furniture_sha256") if c in pages.columns]

    def page(x: dict) -> list[dict]:
        mask = _mask(x)
        gray = R.decode(x["content"]) if x.get("content") is not None else np.where(mask, 0, 255).astype(np.uint8)
        out = []

        def cut(w: dict, tier: str, box: tuple | None, confidence: float | None) -> None:
            base = {"project_id": x["project_id"], "page_name": x["page_name"], "tier": tier, "line": w["line"], "word": w["word"], "text": w["text"], "confidence": confidence}
            if box is None:
                out.append(base | {"reason": "no_ink"})
                return
            got = L.cut_word(mask, box, w["text"])
            base |= {"run_count": got["run_count"], "position_count": got["position_count"], "reason": got["reason"]}
            for c, i, (x0, y0, x1, y1) in got["glyphs"]:
                crop = gray[y0:y1, x0:x1]
                out.append(base | {"glyph": i, "character": c, "box": _box((x0, y0, x1, y1)), "ink": int(mask[y0:y1, x0:x1].sum()), "image": R.write_png(crop), "grid": L.shape(crop).ravel().tolist()})
            if got["reason"]:
                out.append(base)

        for w in x["words"] or []:
            cut(w, "transcribed", _tuple(w["box"]), None)
        for w in x.get("furniture") or []:
            if x.get("furniture_sha256") is not None and x["furniture_sha256"] != x.get("sha256"):
                out.append({"project_id": x["project_id"], "page_name": x["page_name"], "tier": "recognized", "line": w["line"], "word": w["word"], "text": w["text"], "reason": "scan_changed"})
                continue
            inside = L.clipped(_tuple(w["box"]), mask)
            cut(w, "recognized", L.crop_to_ink(mask, inside) if inside else None, w["confidence"])
        return out

    return _per_page(pages.select("project_id", "page_name", "width", "height", "mask", "words", *extra), GLYPHS, page)


def atlas_mismatches(written: DataFrame, glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and sheet of every sheet of a written atlas (keys, sheet, sha256, png) whose bytes are not those that its record and the
    glyphs' crops give; none is the check passed."""
    again = atlas(glyphs, keys).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("sheet").alias("_sheet"), F.col("sha256").alias("_again"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = written.join(again, [*on, F.col("sheet") == F.col("_sheet")], "full_outer")
    same = (F.col("sha256") == F.col("_again")) & (F.sha2("png", 256) == F.col("_again"))
    return both.filter(~F.coalesce(same, F.lit(False))).select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], F.coalesce("sheet", "_sheet").alias("sheet"))


def atlas(glyphs: DataFrame, keys: list[str], cells: int = 1024) -> DataFrame:
    """Sheets of glyph images by keys: sheet, sha256, cells, clipped, png. A sheet, not a key, is one group."""
    from .glyphs import cell_extent, sheets

    size = glyphs.withColumns({"width": F.col("box.x1") - F.col("box.x0"), "height": F.col("box.y1") - F.col("box.y0")})
    extent = cell_extent(size, keys).withColumnsRenamed({k: f"_{k}" for k in keys})
    rows = sheets(size, keys, ["page_name", "line", "word", "glyph"]).join(extent, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    schema = ", ".join(f"{k} string" for k in keys) + ", sheet int, sha256 string, cells int, clipped int, png binary"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell_row", "cell_column"])
        crops = [R.decode(b) for b in pdf["image"]]
        w, h = int(pdf["cell_width"].iloc[0]), int(pdf["cell_height"].iloc[0])
        png = R.write_png(L.atlas_sheet(crops, w, h))
        clipped = sum(c.shape[0] > h or c.shape[1] > w for c in crops)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "sheet": int(pdf["sheet"].iloc[0]), "sha256": hashlib.sha256(png).hexdigest(), "cells": len(crops), "clipped": clipped, "png": png}])

    return rows.select(*keys, "sheet", "cell_row", "cell_column", "cell_width", "cell_height", "image").groupBy(*keys, "sheet").applyInPandas(run, schema)


OVERLAY = "project_id string, page_name string, candidate int, png binary"


def page_overlays(scans: DataFrame, candidates: DataFrame, alignments: DataFrame) -> DataFrame:
    """A review image of each page that has a scan and candidates: the scan with its boxes in the colours of their state."""
    ops = alignments.select("project_id", "page_name", (F.col("state") == "accepted").alias("accepted"), F.transform(F.filter("operations", lambda o: o["kind"] == "match"), lambda o: o["candidate"]).alias("matched"))
    rows = scans.select("project_id", "page_name", "content").join(candidates.select("project_id", "page_name", "candidates").filter("size(candidates) > 0"), ["project_id", "page_name"]).join(ops, ["project_id", "page_name"])

    def page(x: dict) -> list[dict]:
        boxes = [_tuple(c["box"]) for c in x["candidates"]]
        return [{"project_id": x["project_id"], "page_name": x["page_name"], "candidate": None, "png": O.page_overlay(R.decode(x["content"]), boxes, set(x["matched"]), x["accepted"])}]

    return _per_page(rows, OVERLAY, page)


def line_overlays(scans: DataFrame, lines: DataFrame) -> DataFrame:
    """A review image of each measured line: its crop with baseline and x-height."""
    own = lines.filter("measured").groupBy("project_id", "page_name").agg(F.array_sort(F.collect_list(F.struct("candidate", "box", "baseline_row_px", "x_height_top_row_px"))).alias("lines"))

    def page(x: dict) -> list[dict]:
        gray = R.decode(x["content"])
        return [{"project_id": x["project_id"], "page_name": x["page_name"], "candidate": r["candidate"], "png": O.line_overlay(gray, _tuple(r["box"]), r["baseline_row_px"], r["x_height_top_row_px"])} for r in x["lines"]]

    return _per_page(scans.select("project_id", "page_name", "content").join(own, ["project_id", "page_name"]), OVERLAY, page)

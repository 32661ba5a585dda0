"""Invariants as queries: one row a check, with how often it is broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(name: str, broken: DataFrame) -> DataFrame:
    return broken.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("broken"), "n")


def violations(rows: DataFrame, name: str, holds: Column) -> DataFrame:
    """Rows for which a condition is false; unknown counts as false."""
    return counted(name, rows.filter(~F.coalesce(holds, F.lit(False))))


def repeated(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return counted(name, rows.groupBy(*keys).count().filter("count > 1"))


def coverage_gap(rows: DataFrame, keys: list[str], name: str = "coverage_sum") -> DataFrame:
    """Rows less the sum of the counts by keys."""
    total = rows.groupBy(*keys).count().agg(F.sum("count").alias("_s"))
    return rows.agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(total)).select(F.lit(name).alias("broken"), F.abs(F.col("_n") - F.coalesce("_s", F.lit(0))).alias("n"))


def not_contiguous(rows: DataFrame, keys: list[str], start: str, stop: str, name: str) -> DataFrame:
    """Ranges that do not begin where the one before ends, or, the first of a key, at 0."""
    before = F.coalesce(F.lag(stop).over(Window.partitionBy(*keys).orderBy(start)), F.lit(0))
    return counted(name, rows.withColumn("_b", before).filter(F.col("_b") != F.col(start)))


def not_covering(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Rows of two tables with the same columns that the other lacks, counting repeats."""
    return counted(name, left.exceptAll(right).unionAll(right.exceptAll(left)))


def out_of_order(rows: DataFrame, keys: list[str], position: str, order: Column, name: str) -> DataFrame:
    """Rows whose place by `position` is not after that of the row before by `order`."""
    w = Window.partitionBy(*keys).orderBy(position)
    return counted(name, rows.withColumn("_o", order).withColumn("_b", F.lag("_o").over(w)).filter("_b is not null and not (_o > _b)"))


def page_coherence(measurements: DataFrame) -> DataFrame:
    """Measurements that are none of: unavailable, undecodable, blank, measured. Each form has its own columns and diagnostic."""
    has = lambda *codes: F.arrays_overlap("diagnostics", F.array(*[F.lit(c) for c in codes]))
    empty = F.col("width").isNull() & F.col("threshold").isNull() & F.col("bounds").isNull() & F.col("margins").isNull()
    unavailable = F.col("sha256").isNull() & empty & has("image_missing", "image_unreadable")
    undecodable = F.col("sha256").isNotNull() & empty & has("image_decode_failed")
    known = F.col("sha256").isNotNull() & F.col("width").isNotNull() & F.col("threshold").isNotNull()
    blank = known & (F.col("foreground_pixels") == 0) & F.col("bounds").isNull() & F.col("margins").isNull() & (F.size("bands") == 0) & has("blank")
    b, m = F.col("bounds"), F.col("margins")
    framed = (m["x0"] == b["x0"]) & (m["y0"] == b["y0"]) & (m["x1"] == F.col("width") - b["x1"]) & (m["y1"] == F.col("height") - b["y1"])
    inside = F.forall("bands", lambda x: (x["y_start"] < x["y_end"]) & (x["y_end"] <= F.col("height")))
    measured = known & (F.col("foreground_pixels") > 0) & (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]) & framed & inside
    measured &= F.col("foreground_pixels") <= (b["x1"] - b["x0"]).cast("long") * (b["y1"] - b["y0"])
    forms = [F.coalesce(f, F.lit(False)).cast("int") for f in (unavailable, undecodable, blank, measured)]
    return violations(measurements, "page_coherence", sum(forms[1:], forms[0]) == 1)


def estimate_coherence(estimates: DataFrame) -> DataFrame:
    """Estimates whose sample is not their distinct evidence, or that have a value without any."""
    named = (F.col("sample_count") == F.size("evidence")) & (F.size("evidence") == F.size(F.array_distinct("evidence")))
    return violations(estimates, "estimate_coherence", named & (F.col("value").isNull() | (F.col("sample_count") > 0)))


def on_boundary(text: Column, at: Column) -> Column:
    """Whether a byte offset into a text's UTF-8 falls between characters."""
    raw = F.encode(text, "utf-8")
    head = F.substring(F.hex(F.substring(raw, at.cast("int") + 1, F.lit(1))), 1, 1)
    return (at >= 0) & (at <= F.octet_length(raw)) & ((at == F.octet_length(raw)) | ~head.isin("8", "9", "A", "B"))


def markup_references(tokens: DataFrame) -> DataFrame:
    """Pages with a span or style off the boundaries of characters, a style beyond the visible text, or a line that refers to a block
    that the page does not have."""
    text = F.col("source_text")
    ends = lambda x: on_boundary(text, x["byte_start"]) & on_boundary(text, x["byte_end"])
    blocks = F.transform("spans", lambda s: s["block_id"])
    continued = F.transform(F.filter("spans", lambda s: s["kind"] == "continued"), lambda s: s["opening_id"])
    known = lambda x: (F.size(F.array_except(x["span_ids"], blocks)) == 0) & (F.size(F.array_except(x["continued_ids"], continued)) == 0)
    inside = F.forall("styles", lambda x: ends(x) & (x["start"] <= x["end"]) & (x["end"] <= F.length("visible_text")))
    return violations(tokens, "markup_references", F.forall("spans", ends) & inside & F.forall("lines", known))


def operation_coverage(alignments: DataFrame, tokens: DataFrame, candidates: DataFrame) -> DataFrame:
    """Lines to be matched and candidates that stand not once among their page's operations, operations on others, and operations out
    of order."""
    page = ["project_id", "page_name"]
    ops = alignments.select(*page, F.posexplode("operations").alias("at", "o")).select(*page, "at", F.col("o.source").alias("source"), F.col("o.candidate").alias("candidate"))
    lines = tokens.select(*page, F.explode("lines").alias("l")).filter("l.matching_eligible and l.visible_text <> ''").select(*page, F.col("l.ordinal").cast("int").alias("source"))
    boxes = candidates.select(*page, F.posexplode("candidates").alias("candidate", "c")).select(*page, "candidate")
    pages = alignments.select(*page)
    some = lambda c: ops.filter(F.col(c).isNotNull()).select(*page, c)
    gaps = not_covering(some("source"), lines.join(pages, page, "left_semi"), "lines_cover").unionByName(not_covering(some("candidate"), boxes.join(pages, page, "left_semi"), "candidates_cover"))
    for c in ("source", "candidate"):
        gaps = gaps.unionByName(out_of_order(ops.filter(F.col(c).isNotNull()), page, "at", F.col(c), f"{c}_order"))
    return gaps


def line_coherence(lines: DataFrame) -> DataFrame:
    """Lines whose measurements are there in part, do not add up, or lie outside the line; words of lines that do not agree, or
    outside their line."""
    fields = ["baseline_row_px", "x_height_top_row_px", "x_height_px", "ascender_extent_px", "descender_extent_px", "stroke_width_px", "skew_slope"]
    there = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))
    none = (there == F.when(F.col("skew_slope").isNotNull(), 1).otherwise(0)) & F.col("reason").isNotNull() & F.col("word_run_count").isNull() & (F.coalesce(F.size("words"), F.lit(-1)) <= 0)
    base, box = F.col("baseline_row_px"), F.col("box")
    adds = (F.col("x_height_px") == base - F.col("x_height_top_row_px")) & (F.col("ascender_extent_px") == base - box["y0"]) & (F.col("descender_extent_px") == box["y1"] - base) & (base >= box["y0"]) & (base < box["y1"])
    inside = F.forall("words", lambda w: (w["x0"] >= box["x0"]) & (w["y0"] >= box["y0"]) & (w["x1"] <= box["x1"]) & (w["y1"] <= box["y1"]))
    agree = F.col("words_reconciled") == (F.col("word_run_count") == F.col("source_word_count"))
    words = agree & F.when(F.col("words_reconciled"), F.size("words") == F.col("word_run_count")).otherwise(F.size("words") == 0) & inside
    return violations(lines, "line_coherence", F.when(F.col("measured"), (there == len(fields)) & adds & words).otherwise(none))


def count_identities(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Pages whose measured and excluded lines are not all lines, or with more reconciled lines than measured ones, or a line twice."""
    out = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("measured").alias("m"), F.count_if(F.col("reason").isNotNull()).alias("x"), F.count_if("words_reconciled").alias("r"), F.countDistinct("candidate").alias("c"))
    return violations(out, "count_identities", (F.col("m") + F.col("x") == F.col("n")) & (F.col("r") <= F.col("m")) & (F.col("c") == F.col("n")))


def glyph_rows(glyphs: DataFrame) -> DataFrame:
    """Glyph rows that break a row's rules: one character, a box, offsets together, confidence and style of the tier that has them."""
    b = F.col("box")
    good = (F.length("character") == 1) & (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]) & F.col("ink_density").between(0, 1) & (F.col("top_offset_px").isNull() == F.col("bottom_offset_px").isNull())
    tier = F.when(F.col("tier") == "transcribed", F.col("confidence").isNull()).when(F.col("tier") == "recognized", F.col("style").isNull() & (F.col("confidence").isNull() | F.col("confidence").between(0, 1)))
    return violations(glyphs, "glyph_rows", good & tier)


def reviewed_lines(reviewed: DataFrame, alignments: DataFrame) -> DataFrame:
    """Reviewed operations (project_id, page_name, kind, source, candidate, decision, intended_source, intended_candidate) that repeat,
    that the page does not have, that are matches of a page not accepted, or that are called correct against what was intended."""
    page = ["project_id", "page_name"]
    ops = alignments.select(*page, "state", F.explode("operations").alias("o")).select(*page, "state", F.col("o.kind").alias("_k"), F.col("o.source").alias("_s"), F.col("o.candidate").alias("_c"))
    met = reviewed.join(ops, page, "left_outer").withColumn("_hit", (F.col("kind") == F.col("_k")) & F.col("source").eqNullSafe(F.col("_s")) & F.col("candidate").eqNullSafe(F.col("_c")))
    rows = met.groupBy(*reviewed.columns).agg(F.max(F.coalesce("_hit", F.lit(False))).alias("_hit"), F.max("state").alias("_state"))
    sane = F.col("_hit") & ((F.col("kind") != "match") | (F.col("_state") == "accepted"))
    sane &= (F.col("decision") != "correct") | (F.col("intended_source").eqNullSafe(F.col("source")) & F.col("intended_candidate").eqNullSafe(F.col("candidate")))
    return violations(rows, "reviewed_lines", sane).unionByName(repeated(reviewed, [*page, "kind", "source", "candidate"], "reviewed_twice"))

"""Structural evidence of a transcribed page, and its score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions.text import CONTROL, bound, deviation, lines, middle, nonblank, strip, tag_count

#: Weight of each component of a page's score, and the cap of the counted ones.
WEIGHTS = {"special_format": 5, "leaders_or_fields": 8, "table_like": 8, "poetry_like": 8, "quotation_like": 6, "multipart_name": 6, "illustration_or_ornament": 4, "uncertainty_note": 2}
COUNTED = ("italic_tags", "bold_tags", "small_caps_tags")
CAP = 10
#: The review groups, in the order of selection.
GROUPS = ("mixed_typography", "table_like_structure", "poetry", "quotation", "multipart_layout")


def local_blocks(pages: DataFrame, text: str = "text") -> DataFrame:
    """Adds source_text, feature_text, blocks and malformed for pages whose blocks all begin and end on the page.

    A left-to-right fold over the control markers: an opener inside a block, or a closer of the other kind, makes the block
    invalid; an invalid or unclosed block's text counts nowhere.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = pages.withColumn("source_text", t).withColumn("_c", F.regexp_extract_all("source_text", F.lit(f"({CONTROL})"), F.lit(1))).withColumn("_p", F.split("source_text", CONTROL))
    none = F.lit("")
    start = F.struct(F.lit("").alias("kind"), F.lit(True).alias("valid"), none.alias("body"), F.get("_p", F.lit(0)).alias("feature"), F.array().cast("array<string>").alias("blocks"), F.lit(0).alias("bad"))
    step = F.transform("_c", lambda c, i: F.struct(c.alias("c"), F.get("_p", i + 1).alias("t")))

    def fold(s: Column, x: Column) -> Column:
        opener = x["c"].isin("/*", "/#")
        kind = F.when(x["c"].isin("/*", "*/"), "local").otherwise("continued")
        out = s["kind"] == ""
        opens, stray = opener & out, ~opener & out
        closes = ~opener & (s["kind"] == kind)
        keeps = closes & s["valid"]
        body, feature, blocks = s["body"], s["feature"], s["blocks"]
        return F.struct(
            F.when(opens, kind).when(closes | stray, "").otherwise(s["kind"]).alias("kind"),
            F.when(opens | closes | stray, True).otherwise(False).alias("valid"),
            F.when(opens, x["t"]).when(closes | stray, "").otherwise(F.concat(body, x["t"])).alias("body"),
            F.when(keeps, F.concat(feature, body, x["t"])).when(closes | stray, F.concat(feature, x["t"])).otherwise(feature).alias("feature"),
            F.when(keeps, F.concat(blocks, F.array(body))).otherwise(blocks).alias("blocks"),
            (s["bad"] + F.when(opens | closes, 0).otherwise(1)).alias("bad"),
        )

    rows = rows.withColumn("_f", F.aggregate(step, start, fold))
    return rows.withColumns({"feature_text": F.col("_f.feature"), "blocks": F.col("_f.blocks"), "malformed": F.col("_f.bad") + F.when(F.col("_f.kind") != "", 1).otherwise(0)}).drop("_c", "_p", "_f")


def _aligned(line: Column) -> Column:
    return line.contains("   ") & strip(line).rlike(r"(?s)^\S(?:.*?\S)? {3,}\S(?:.*\S)?$")


def _quoted(line: Column) -> Column:
    """Begins and ends, but for white space, with a straight quote, or with an opening and a closing one."""
    return line.rlike(r"(?sU)^[\s\u001c-\u001f]*(?:\"(?:.*\")?|\u201c.*\u201d)[\s\u001c-\u001f]*$")


def _quoted_run(rows: Column) -> Column:
    """Whether four lines in a row of a block (all its lines) are quoted."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def fold(s: Column, x: Column) -> Column:
        return bound(F.when(_quoted(x), s["run"] + 1).otherwise(0), lambda run: F.struct(run.alias("run"), F.greatest(s["best"], run).alias("best")))

    return (F.size(rows) >= 4) & (F.aggregate(rows, zero, fold)["best"] >= 4)


def _indented(rows: Column) -> Column:
    """Whether a block's lines (two or more, none blank) all begin with the same spaces or tabs."""
    same = lambda x: (F.size(x) == 1) & (F.get(x, F.lit(0)) != "")
    return (F.size(rows) >= 2) & bound(F.array_distinct(F.transform(rows, lambda x: F.regexp_extract(x, "^[ \t]*", 0))), same)


def page_features(parsed: DataFrame, name: str = "page_name") -> DataFrame:
    """Adds the twelve features to pages that local_blocks or parse_pages has taken apart."""
    rows = parsed.withColumn("_all", F.transform("blocks", lines)).withColumn("_l", F.transform("_all", nonblank))
    rows = rows.withColumn("_page", F.transform(nonblank(lines(F.col("source_text"))), lambda x: F.length(strip(x))))
    rows = rows.withColumn("_page_mid", middle(F.col("_page"))).withColumn("_rows", F.transform("_l", lambda b: F.size(F.filter(b, _aligned))))
    rows = rows.withColumn("_len", F.transform("_l", lambda b: F.transform(b, lambda x: F.length(strip(x)))))
    poetry = F.exists("_len", lambda n: (F.size(n) >= 4) & (middle(n) < F.col("_page_mid") * F.lit(0.7)) & (deviation(n) != 0))
    out = rows.withColumns(
        {
            "special_format": F.size("blocks") > 0,
            "italic_tags": tag_count(F.col("feature_text"), "i"),
            "bold_tags": tag_count(F.col("feature_text"), "b"),
            "small_caps_tags": tag_count(F.col("feature_text"), "sc"),
            "dot_leaders": F.exists("blocks", lambda b: b.rlike(r"\.(?: *\.){2,}")),
            "aligned_fields": F.exists("_rows", lambda n: n >= 2),
            "table_like": F.exists("_rows", lambda n: n >= 3),
            "poetry_like": F.coalesce(poetry, F.lit(False)),
            "quotation_like": F.exists("_l", _indented) | F.exists("_all", _quoted_run),
            "multipart_name": F.col(name).rlike(r"[LMR]\.[^.]+$"),
            "illustration_or_ornament": F.col("source_text").rlike(r"(?iu)\[(?:illustration|decoration)\b[^\]]*\]"),
            "uncertainty_note": F.col("source_text").contains("[**"),
        }
    )
    return out.drop("_all", "_l", "_page", "_page_mid", "_rows", "_len")


def components() -> dict[str, Column]:
    """The eleven components of a page's score."""
    flags = {k: F.col(k) for k in WEIGHTS if k != "leaders_or_fields"} | {"leaders_or_fields": F.col("dot_leaders") | F.col("aligned_fields")}
    return {k: F.least(F.col(k), F.lit(CAP)).cast("int") for k in COUNTED} | {k: c.cast("int") * WEIGHTS[k] for k, c in flags.items()}


def matched_groups() -> Column:
    """The review groups that a page's features match, in fixed order."""
    hit = {
        "mixed_typography": (F.col("italic_tags") > 0) | (F.col("bold_tags") > 0) | (F.col("small_caps_tags") > 0),
        "table_like_structure": F.col("table_like") | F.col("dot_leaders") | F.col("aligned_fields"),
        "poetry": F.col("poetry_like"),
        "quotation": F.col("quotation_like"),
        "multipart_layout": F.col("multipart_name"),
    }
    return F.array_compact(F.array(*[F.when(hit[g], F.lit(g)) for g in GROUPS]))


def scored_pages(parsed: DataFrame, name: str = "page_name") -> DataFrame:
    """Features, components as a map, score and groups of each page."""
    rows = page_features(parsed, name)
    parts = components()
    return rows.withColumns({"components": F.create_map(*[x for k, c in parts.items() for x in (F.lit(k), c)]), "score": sum(parts.values(), F.lit(0)), "groups": matched_groups()})

"""Queries that run page kernels; what SQL can't express has no SQL here, and tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.operators import pages as P
from inkfold.operators.features import scored_pages

from .adapters import spread, table
from .q_pages import marked

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = (run, sql)
        return run

    return add


def tokens(spark, d):
    return P.tokenized(marked(spark, d))


def scans(spark, d):
    """embeddings as plain graymaps of eight by eight pixels, each pixel six by four."""
    pixel = F.transform("embedding", lambda v: F.least(F.greatest(F.floor(128 + 300 * v.cast("double")), F.lit(0)), F.lit(255)).cast("string"))
    row = lambda y: F.flatten(F.array_repeat(F.flatten(F.transform(F.slice("_p", F.lit(8) * y + 1, F.lit(8)), lambda v: F.array_repeat(v, 6))), 4).cast("array<array<string>>"))
    rows = spread(table(spark, d, "embeddings")).select(F.concat(F.lit("book"), "label").alias("project_id"), F.concat(F.lit("p"), "vec_id", F.lit(".pgm")).alias("page_name"), pixel.alias("_p"))
    body = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), row)), " ")
    return rows.select("project_id", "page_name", F.concat(F.lit("P2 48 32 255\n"), body).cast("binary").alias("content"))


@query()
def tokenized_pages(spark, d):
    t = tokens(spark, d)
    return t.select("project_id", "page_name", F.length("visible_text").alias("visible_chars"), F.size("lines").alias("lines"), F.size("operations").alias("operations"), F.size("styles").alias("styles"), F.size("spans").alias("spans"), F.size("diagnostics").alias("diagnostics"))


@query()
def html_tokens(spark, d):
    rows = table(spark, d, "pages").select(F.regexp_extract("url", r"//([^/]+)", 1).alias("project_id"), F.concat(F.lit("p"), "page_id").alias("page_name"), F.col("html").alias("text"))
    t = P.tokenized(rows)
    codes = F.transform("diagnostics", lambda x: x["code"])
    n = lambda code: F.size(F.filter(codes, lambda c: c == code))
    return t.select("page_name", n("unknown_tag").alias("unknown"), n("malformed_markup").alias("malformed"), n("unmatched_style_tag").alias("unmatched"), F.size("styles").alias("styles"))


@query()
def tokenized_features(spark, d):
    return scored_pages(tokens(spark, d)).select("page_name", "score", F.array_join("groups", "+").alias("groups"), "special_format", "table_like", "poetry_like")


@query()
def scan_measurements(spark, d):
    m = P.measured(scans(spark, d))
    return m.select("project_id", "page_name", "threshold", "foreground_pixels", F.size("bands").alias("bands"), "band_height", F.array_join("diagnostics", "+").alias("diagnostics"))


@query()
def line_candidates(spark, d):
    e = P.extracted(scans(spark, d))
    return e.select("project_id", "page_name", F.size("candidates").alias("candidates"), F.size("rejected").alias("rejected"), F.array_join("exclusions", "+").alias("exclusions"))


def turns(spark, d):
    """Conversations as pages, (tokens, candidates): the user's turns are source lines, the other turns candidate boxes as wide as their text."""
    from pyspark.sql import Window

    rows = table(spark, d, "conversations").withColumns({"_user": F.col("role") == "user", "page_name": F.col("conv_id").cast("string"), "project_id": F.lit("c")})
    w = Window.partitionBy("page_name", "_user").orderBy("turn", "text")
    rows = rows.withColumn("_i", (F.row_number().over(w) - 1).cast("int"))
    page = Window.partitionBy("page_name")
    rows = rows.withColumns({"_wide": F.greatest(F.max(F.length("text")).over(page), F.lit(1)), "_bytes": F.greatest(F.max(F.octet_length("text")).over(page), F.lit(1)).cast("long")})
    size = F.length("text").cast("int")
    text = F.regexp_replace("text", r"\s+", " ")
    start = F.col("_i") * (F.col("_bytes") + 1)
    line = F.struct(F.col("_i").alias("ordinal"), start.alias("byte_start"), (start + F.col("_bytes")).alias("content_end"), (start + F.col("_bytes") + 1).alias("byte_end"), text.alias("original_text"), text.alias("visible_text"),
                    F.lit(0).alias("first_operation"), F.lit(0).alias("operations"), F.array().cast("array<string>").alias("span_ids"), F.array().cast("array<string>").alias("continued_ids"), F.lit(True).alias("matching_eligible"), F.lit(True).alias("style_eligible"))
    box = F.struct(F.lit(0).alias("x0"), (F.col("_i") * 20).alias("y0"), F.greatest(size, F.lit(1)).alias("x1"), (F.col("_i") * 20 + 12).alias("y1"))
    candidate = F.struct(F.col("_i").alias("band"), box.alias("box"), F.lit(1).cast("long").alias("ink"), F.lit(1).alias("components"), F.array(F.lit(1.0)).alias("profile"))
    of = lambda c, x: F.array_sort(F.collect_list(F.when(c, x)))
    pages = rows.groupBy("project_id", "page_name").agg(of(F.col("_user"), line).alias("lines"), of(~F.col("_user"), candidate).alias("candidates"), F.max("_wide").alias("_wide"))
    pages = pages.withColumn("styles", F.expr(f"cast(array() as array<struct<{P.STYLE}>>)"))
    cand = pages.select("project_id", "page_name", F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("_wide").alias("x1"), F.lit(4000).alias("y1")).alias("bounds"), "candidates", F.expr(f"cast(null as {P.BOX})").alias("gutter"), F.array().cast("array<string>").alias("exclusions"))
    return pages.select("project_id", "page_name", "lines", "styles"), cand


@query()
def turn_alignment(spark, d):
    return P.aligned(*turns(spark, d)).select("page_name", "state", F.array_join("exclusions", "+").alias("exclusions"), F.round("normalized_cost", 9).alias("cost"), F.size("operations").alias("operations"))


@query("SELECT unnest(['page_coherence', 'markup_references', 'pages_unique', 'lines_cover', 'candidates_cover', 'source_order', 'candidate_order', 'natural_order']) AS broken, 0::BIGINT AS n")
def stage_invariants(spark, d):
    """What must hold of measured scans, marked pages and aligned turns; each count is of breaches."""
    from inkfold.functions.text import natural_key
    from inkfold.operators import checks
    from inkfold.operators.selection import ranked

    page = ["project_id", "page_name"]
    marked_pages = tokens(spark, d)
    lines, boxes = turns(spark, d)
    out = checks.page_coherence(P.measured(scans(spark, d))).unionByName(checks.markup_references(marked_pages)).unionByName(checks.repeated(marked_pages, page, "pages_unique"))
    out = out.unionByName(checks.operation_coverage(P.aligned(lines, boxes), lines, boxes))
    order = [natural_key(F.col("page_name"))]
    return out.unionByName(checks.out_of_order(ranked(marked_pages.select(*page), ["project_id"], order, "at"), ["project_id"], "at", order[0], "natural_order"))

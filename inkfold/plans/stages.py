"""The five stages over a corpus: rank, profile, align, typography, glyphs; each gives tables that the next one reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfold.functions.text import half_up, letters_only, natural_key
from inkfold.operators import glyphs as G
from inkfold.operators import pages as P
from inkfold.operators.features import GROUPS, scored_pages
from inkfold.operators.histogram import MIN_GAPS, VALLEY_SPLIT, clamped, otsu
from inkfold.operators.intervals import contained
from inkfold.operators.islands import gaps
from inkfold.operators.pooling import one, page_medians, pool_estimate, pool_pages, unpooled
from inkfold.operators.review import AGREEMENT_MIN
from inkfold.operators.selection import coverage_first
from inkfold.operators.templates import classify, fit_templates, head_ordinal, head_windows
from inkfold.operators.witness import first_runs, tallies
from inkfold.sources import corpus

PAGE = ["project_id", "page_name"]


def _order() -> list:
    return [-F.col("score"), natural_key(F.col("page_name"))]


def project_scores(pages: DataFrame) -> DataFrame:
    """project_id, top_ten_page_scores, group_bonus, score: the ten best page scores and twenty for each group that any page matches.

    Pages are counted by score where they are, so a project comes down to a row a score, however many pages it has.
    """
    hits = [F.max(F.array_contains("groups", g).cast("int")).alias(f"_g{i}") for i, g in enumerate(GROUPS)]
    levels = pages.groupBy("project_id", "score").agg(F.count(F.lit(1)).alias("_n"), *hits)
    above = F.coalesce(F.sum("_n").over(Window.partitionBy("project_id").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.least("_n", F.greatest(10 - above, F.lit(0)))
    found = sum((F.max(f"_g{i}") for i in range(len(GROUPS))), F.lit(0))
    out = levels.withColumn("_t", taken * F.col("score")).groupBy("project_id").agg(F.sum("_t").alias("top_ten_page_scores"), (20 * found).alias("group_bonus"))
    return out.withColumn("score", F.col("top_ten_page_scores") + F.col("group_bonus"))


def rank(spark: SparkSession, root: str, project_limit: int = 50, pages_per_project: int = 12) -> dict[str, DataFrame]:
    """projects (ranked), pages (selected for review), diagnostics, tokens (all pages taken apart)."""
    meta, f2, other, scans = corpus.projects(spark, root), corpus.f2_pages(spark, root), corpus.transcriptions(spark, root), corpus.scans(spark, root).drop("content")
    good = meta.filter("diagnostic is null")
    pages = f2.filter("diagnostic is null").join(good.select("project_id"), "project_id", "left_semi")
    tokens = P.tokenized(pages)
    scored = scored_pages(tokens)
    projects = project_scores(scored).join(good, "project_id").select("project_id", "metadata", "top_ten_page_scores", "group_bonus", "score")
    top = projects.orderBy(F.col("score").desc(), "project_id").limit(project_limit)
    chosen = coverage_first(scored.join(top.select("project_id"), "project_id", "left_semi"), ["project_id"], "page_name", _order(), GROUPS, pages_per_project)
    chosen = chosen.join(scored.select(*PAGE, "score", "components", "groups"), PAGE)
    known = other.filter("diagnostic is null").select(*PAGE, F.lit(True).alias("_t"))
    chosen = chosen.join(known, PAGE, "left").join(scans.select(*PAGE, F.lit(True).alias("_s")), PAGE, "left")
    chosen = chosen.withColumns({"transcription_available": F.col("_t").isNotNull(), "image_available": F.col("_s").isNotNull()}).drop("_t", "_s")
    code = lambda df, c, name=None: df.select(F.col(c).alias("code"), "project_id", (F.col(name) if name else F.lit(None).cast("string")).alias("page_name"))
    missing = meta.join(f2.select("project_id").distinct(), "project_id", "left_anti").withColumn("diagnostic", F.lit("missing_f2"))
    absent = corpus.missing_transcriptions(spark, root, good)
    unsafe = corpus.unresolvable(pages)
    odd = code(absent, "diagnostic").unionByName(code(unsafe, "diagnostic", "page_name")).unionByName(code(meta.filter("diagnostic is not null"), "diagnostic")).unionByName(code(f2.filter("diagnostic is not null"), "diagnostic")).unionByName(code(other.filter("diagnostic is not null"), "diagnostic")).unionByName(code(missing, "diagnostic"))
    odd = odd.unionByName(tokens.select(F.explode("diagnostics").alias("x"), *PAGE).select(F.col("x.code").alias("code"), *PAGE))
    return {"projects": top, "pages": chosen, "diagnostics": odd.orderBy("code", F.coalesce("project_id", F.lit("")), F.coalesce("page_name", F.lit(""))), "tokens": tokens}


def selected(scans: DataFrame, pages: DataFrame, whole_book: bool = True) -> DataFrame:
    """scans(project_id, page_name, ...) of the ranked projects with `emit`, whether rank selected the page; without whole_book the
    selected pages alone. pages: rank()['pages']."""
    own = pages.select(*PAGE).distinct().withColumn("emit", F.lit(True))
    if not whole_book:
        return scans.join(own, PAGE)
    books = scans.join(own.select("project_id").distinct(), "project_id", "left_semi")
    return books.join(own, PAGE, "left").withColumn("emit", F.coalesce("emit", F.lit(False)))


def pooling_exclusion() -> Column:
    """Why a page measurement (width, diagnostics, bounds) takes no part in its book's estimates, the first reason that holds; else null."""
    has = lambda c: F.array_contains("diagnostics", c)
    ladder = F.when(F.col("width").isNull(), "image_unavailable").when(has("blank"), "blank_page").when(has("border_dominated"), "border_dominated")
    return ladder.when(has("high_foreground_ratio"), "high_foreground_ratio").when(F.col("bounds").isNull(), "foreground_bounds_unavailable")


def profile(scans: DataFrame) -> dict[str, DataFrame]:
    """measurements, templates, classes (with furniture bands) and pooled metrics of scans(project_id, page_name, content)."""
    m = P.measured(scans)
    tops = F.transform("bands", lambda b: b["y_start"])
    geometry = m.filter("size(bands) > 0 and bounds is not null").select(
        F.col("project_id").alias("book"), F.col("page_name").alias("page"), "page_name", F.get(tops, F.lit(0)).alias("first_top"), F.col("bounds.x0").alias("text_left"), F.col("bounds.x1").alias("text_right"), F.size("bands").alias("band_count"), tops.alias("_tops")
    )
    templates = fit_templates(geometry)
    # The head is the first band at or below the window; all bands down to it are furniture on a normal page.
    rows = geometry.join(head_windows(geometry).select("book", F.col("center").alias("_c"), F.col("window").alias("_w")), "book")
    at = head_ordinal(F.col("_tops"), F.col("_c"), F.col("_w"))
    rows = rows.withColumn("_head", at).withColumn("head_top", F.get("_tops", F.col("_head")))
    classes = classify(rows.select("book", "page", "first_top", "head_top", "text_left"), templates)
    normal = F.col("page_class").isin("normal_recto", "normal_verso")
    classes = classes.join(rows.select("book", "page", "_head"), ["book", "page"]).select(
        F.col("book").alias("project_id"), F.col("page").alias("page_name"), "page_class", "residual", "confidence", F.when(normal, F.sequence(F.lit(0), F.col("_head"))).otherwise(F.array().cast("array<int>")).alias("furniture")
    )
    value = {
        "foreground_share": F.col("foreground_pixels") / (F.col("width") * F.col("height")), "left_margin": F.col("margins.x0"), "top_margin": F.col("margins.y0"), "right_margin": F.col("margins.x1"), "bottom_margin": F.col("margins.y1"),
        "band_height": F.col("band_height"), "band_pitch": F.col("band_pitch"),
    }
    ladder = pooling_exclusion()
    long = m.select(*PAGE, ladder.alias("_x"), F.inline(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("v")) for k, v in value.items()])))
    long = long.withColumn("_x", F.coalesce("_x", F.when(F.col("v").isNull(), F.concat(F.col("name"), F.lit("_unavailable")))))
    pooled = pool_estimate(long, ["project_id", "name"], "v", F.col("page_name"), F.col("_x"), natural_key(F.col("page_name")))
    return {"measurements": m, "templates": templates, "classes": classes, "estimates": pooled}


def unchanged(candidates: DataFrame, measurements: DataFrame) -> DataFrame:
    """candidates with source_changed first among the exclusions, and no boxes, where the scan is not the one that was measured."""
    rows = candidates.join(measurements.select(*PAGE, F.col("sha256").alias("_was")), PAGE, "left")
    changed = F.col("sha256").isNotNull() & F.col("_was").isNotNull() & (F.col("sha256") != F.col("_was"))
    none = F.filter("candidates", lambda c: F.lit(False))
    return rows.withColumns({"exclusions": F.when(changed, F.concat(F.array(F.lit("source_changed")), "exclusions")).otherwise(F.col("exclusions")), "candidates": F.when(changed, none).otherwise(F.col("candidates"))}).drop("_was")


def align(tokens: DataFrame, scans: DataFrame, classes: DataFrame, measurements: DataFrame | None = None) -> dict[str, DataFrame]:
    """candidates and alignments of pages that have a scan; furniture bands make no candidates, nor does a scan that has changed
    since it was measured."""
    rows = scans.select(*PAGE, "content").join(classes.select(*PAGE, "furniture"), PAGE, "left")
    candidates = P.extracted(rows)
    candidates = unchanged(candidates, measurements) if measurements is not None else candidates
    return {"candidates": candidates, "alignments": P.aligned(scored_pages(tokens), candidates)}


def gap_thresholds(lines: DataFrame) -> DataFrame:
    """project_id, threshold, valley, samples, rule: where a book's gaps are two populations, their split; else null.

    lines: project_id, page_name, line, profile.
    """
    ink = lines.select("project_id", "page_name", "line", F.posexplode("profile").alias("col", "v")).filter("v > 0")
    hist = clamped(gaps(ink, ["project_id", "page_name", "line"], "col"), ["project_id"], "gap")
    rows = hist.join(otsu(hist, ["project_id"]), "project_id")
    most = lambda c: F.max(F.when(c, F.col("n")))
    level, t = F.col("level"), F.col("threshold")
    out = rows.groupBy("project_id", "threshold").agg(F.sum("n").alias("samples"), most(level <= t).alias("_l"), most(level > t).alias("_r"), most(level == t).alias("_a"))
    valley = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.coalesce("_a", F.lit(0)) / F.least("_l", "_r"))
    out = out.withColumn("valley", valley)
    good = (F.col("samples") >= MIN_GAPS) & (F.col("valley") <= F.lit(VALLEY_SPLIT))
    return out.select("project_id", "samples", "valley", F.when(good, "otsu-valley").otherwise("x-height-ratio").alias("rule"), F.when(good, F.greatest(F.lit(2), t)).cast("int").alias("gap"))


def matched(tokens: DataFrame, candidates: DataFrame, alignments: DataFrame) -> DataFrame:
    """project_id, page_name, line (source ordinal), candidate, box, profile, ink, text of accepted pages' matches."""
    ops = alignments.filter("state = 'accepted'").select(*PAGE, F.explode("operations").alias("o")).filter("o.kind = 'match'").select(*PAGE, F.col("o.source").alias("line"), F.col("o.candidate").alias("candidate"))
    boxes = candidates.select(*PAGE, F.posexplode("candidates").alias("candidate", "c")).select(*PAGE, "candidate", F.col("c.box").alias("box"), F.col("c.profile").alias("profile"), F.col("c.ink").alias("ink"))
    source = tokens.select(*PAGE, F.explode("lines").alias("l")).select(*PAGE, F.col("l.ordinal").alias("line"), F.col("l.visible_text").alias("text"))
    return ops.join(boxes, [*PAGE, "candidate"]).join(source, [*PAGE, "line"])


#: Names of style tags spelled out.
STYLE_NAMES = {"i": "italic", "b": "bold", "sc": "small_caps", "g": "gesperrt", "f": "f", "tb": "thought_break"}


def line_styles(tokens: DataFrame) -> DataFrame:
    """project_id, page_name, source (line ordinal), spans: the styles that cover a part of a line's visible text, as half-open ranges
    from the line's first character, with their names. Every line has a row."""
    size = lambda l: F.length(l["visible_text"]) + F.when(l["byte_end"] > l["content_end"], 1).otherwise(0)  # noqa: E731, E741
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate("lines", zero, lambda s, l: F.struct((s["at"] + size(l)).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")))["starts"]
    rows = tokens.select(*PAGE, "styles", F.explode(F.arrays_zip(F.col("lines").alias("l"), starts.alias("s"))).alias("x"))
    begin, end = F.col("x.s"), F.col("x.s") + F.length("x.l.visible_text")
    names = F.create_map(*[F.lit(v) for kv in STYLE_NAMES.items() for v in kv])
    on = F.filter("styles", lambda r: (r["start"] < end) & (r["end"] > begin))
    spans = F.transform(on, lambda r: F.struct((F.greatest(r["start"], begin) - begin).alias("start"), (F.least(r["end"], end) - begin).alias("stop"), F.coalesce(F.try_element_at(names, r["kind"]), r["kind"]).alias("kind")))
    return rows.select(*PAGE, F.col("x.l.ordinal").alias("source"), spans.alias("spans"))


def style_at(spans: Column, offset: Column) -> Column:
    """The names of the styles on a character, in order and joined by +; roman where none is; null without spans."""
    kinds = F.array_sort(F.array_distinct(F.transform(F.filter(spans, lambda s: (s["start"] <= offset) & (offset < s["stop"])), lambda s: s["kind"])))
    return F.when(spans.isNotNull(), F.when(F.size(kinds) > 0, F.array_join(kinds, "+")).otherwise("roman"))


def word_start(text: Column, word: Column) -> Column:
    """Where a word, by its ordinal among those between white space, begins in a text."""
    parts = F.regexp_extract_all(text, F.lit(r"(?U)(\s*\S+)"), F.lit(1))
    before = F.aggregate(F.slice(parts, F.lit(1), word), F.lit(0), lambda s, x: s + F.length(x))
    return before + F.length(F.regexp_extract(F.get(parts, word), r"(?U)^(\s*)", 1))


def typography(tokens: DataFrame, candidates: DataFrame, alignments: DataFrame, measurements: DataFrame, classes: DataFrame, witness: DataFrame | None = None) -> dict[str, DataFrame]:
    """thresholds, lines, pages (medians), estimates (books and styles), unpooled pages by style, accuracy of accepted pages, and with
    a witness (sources.corpus.require_witness) its tallies by page and book."""
    lines = matched(tokens, candidates, alignments)
    thresholds = gap_thresholds(lines)
    pages = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("candidate", "box", "profile", "ink", "text"))).alias("matched"))
    pages = pages.join(candidates.select(*PAGE, "mask"), PAGE).join(measurements.select(*PAGE, "width", "height", F.col("bounds.x0").alias("text_left")), PAGE).join(thresholds.select("project_id", "gap"), "project_id", "left")
    rows = P.line_typography(pages).join(classes.select(*PAGE, "page_class"), PAGE, "left").withColumn("style", F.when(F.col("page_class").isin("normal_recto", "normal_verso"), "body").when(F.col("page_class") == "chapter_opening", "chapter_opening"))
    rows = rows.join(lines.select(*PAGE, "candidate", F.col("line").alias("source")), [*PAGE, "candidate"])
    rows = first_runs(rows, witness) if witness is not None else rows
    ok = lambda c: one(F.when(F.col("measured"), F.col(c)))
    w = Window.partitionBy(*PAGE).orderBy("candidate")
    beside = (F.lag("candidate").over(w) == F.col("candidate") - 1) & F.lag("measured").over(w) & F.col("measured")
    rows = rows.withColumn("pitch", F.when(beside, F.col("baseline_row_px") - F.lag("baseline_row_px").over(w)))
    gaps_of = F.when(F.col("words_reconciled") & F.col("measured"), F.transform("word_gaps", lambda g: g.cast("double")))
    metrics = {
        "line_height": (one(F.col("box.y1") - F.col("box.y0")), "no_matched_lines"), "line_width": (one(F.col("box.x1") - F.col("box.x0")), "no_matched_lines"),
        **{n: (ok(c), "no_measured_lines") for n, c in {"x_height": "x_height_px", "ascender_extent": "ascender_extent_px", "descender_extent": "descender_extent_px", "stroke_width": "stroke_width_px", "skew": "skew_slope"}.items()},
        "line_indent": (one(F.col("indent_px")), "no_indent_reference"), "baseline_pitch": (one(F.col("pitch")), "no_baseline_pitch"),
        "word_gap": (F.coalesce(gaps_of, F.array().cast("array<double>")), "no_reconciled_word_gaps"),
    }
    medians = page_medians(rows, [*PAGE, "style"], metrics)
    estimates = pool_pages(medians, "project_id", "style")
    words = F.col("source_word_count")
    accuracy = rows.filter("measured").groupBy("project_id").agg(F.sum(F.greatest(F.lit(0), words - 1)).alias("gaps"), F.sum(F.abs(F.col("word_run_count") - words)).alias("wrong"), F.count_if("words_reconciled").alias("reconciled"), F.count(F.lit(1)).alias("lines"))
    out = {
        "thresholds": thresholds, "lines": rows, "pages": medians, "estimates": estimates, "unpooled": unpooled(rows, "project_id", "page_name", "style", natural_key(F.col("page_name"))),
        "accuracy": accuracy.withColumn("gap_accuracy", 1 - F.try_divide("wrong", "gaps")),
    }
    return out | ({"witnessed": tallies(rows, PAGE), "books_witnessed": tallies(rows, ["project_id"])} if witness is not None else {})


def furniture_words(witness: DataFrame, candidates: DataFrame) -> DataFrame:
    """Recognised words that no line box holds: running heads, folios and signatures. witness: sources.corpus.witness_words."""
    page = F.struct("project_id", "page_name").alias("page")
    words = witness.select(page, "word", "line_index", "word_index", "confidence", "image_sha256", "box.*")
    boxes = candidates.select(page, F.posexplode("candidates").alias("box_id", "c")).select("page", "box_id", "c.box.*")
    outside = contained(words, boxes, "left_anti")
    return outside.select(F.col("page.project_id").alias("project_id"), F.col("page.page_name").alias("page_name"), "word", "line_index", "word_index", "confidence", "image_sha256", F.struct("x0", "y0", "x1", "y1").alias("box"))


def admitted_lines(witness: DataFrame, lines: DataFrame, least: float = AGREEMENT_MIN) -> DataFrame:
    """project_id, page_name, candidate, agreement of lines whose words the recogniser read as well within their box, from the least agreement on.
    All words between white space count, those without a letter or digit as not read; a line without words has no agreement."""
    page = F.struct("project_id", "page_name").alias("page")
    w = witness.select(page, F.monotonically_increasing_id().alias("word_id"), letters_only(F.col("word")).alias("word"), "box.*")
    b = lines.select(page, F.col("candidate").alias("box_id"), "box.*")
    read = contained(w, b).select("page", F.col("box_id").alias("candidate"), "word").filter("word <> ''").distinct()
    own = lines.select(page, "candidate", F.explode(F.split("text", r"(?U)\s+")).alias("x")).filter("x <> ''").select("page", "candidate", letters_only(F.col("x")).alias("word"))
    both = own.join(read.withColumn("_r", F.lit(1)), ["page", "candidate", "word"], "left").groupBy("page", "candidate").agg((F.count("_r") / F.count(F.lit(1))).alias("agreement"))
    return both.filter(F.col("agreement") >= F.lit(least)).select("page.*", "candidate", "agreement")


def glyphs(lines: DataFrame, candidates: DataFrame, measurements: DataFrame, tokens: DataFrame | None = None, scans: DataFrame | None = None, witness: DataFrame | None = None, alignments: DataFrame | None = None) -> dict[str, DataFrame]:
    """cuts (words that gave none, with reasons), glyphs (flagged), coverage, atlas, x_height by page.

    lines: typography()['lines'], of which the reconciled ones are cut. With tokens a glyph has the style of its character in the
    transcription; with scans crops and shapes are of gray levels; with witness and alignments the words that the recogniser read
    outside all lines of accepted pages give the tier `recognized`, where it read the scan that was aligned.
    """
    parts = F.arrays_zip(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "").alias("t"), F.col("words").alias("b"))
    words = lines.filter("words_reconciled").select(*PAGE, F.col("candidate").alias("line"), F.posexplode(parts).alias("word", "w"))
    pages = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line", "word", F.col("w.t").alias("text"), F.col("w.b").alias("box")))).alias("words"))
    if witness is not None and alignments is not None:
        accepted = alignments.filter("state = 'accepted'").select(*PAGE)
        loose = furniture_words(witness.join(accepted, PAGE, "left_semi"), candidates)
        entry = F.struct(F.col("line_index").alias("line"), F.col("word_index").alias("word"), F.col("word").alias("text"), "box", "confidence")
        loose = loose.groupBy(*PAGE).agg(F.array_sort(F.collect_list(entry)).alias("furniture"), F.min("image_sha256").alias("furniture_sha256"))
        pages = pages.join(loose, PAGE, "full_outer")
    pages = pages.join(candidates.select(*PAGE, "mask", "sha256"), PAGE).join(measurements.select(*PAGE, "width", "height"), PAGE)
    pages = pages.join(scans.select(*PAGE, "content"), PAGE) if scans is not None else pages
    cuts = P.cut_glyphs(pages)
    good = cuts.filter("reason is null").withColumns({"width": F.col("box.x1") - F.col("box.x0"), "height": F.col("box.y1") - F.col("box.y0")})
    band = lines.filter("measured").select(*PAGE, F.lit("transcribed").alias("tier"), F.col("candidate").alias("line"), F.col("box").alias("line_box"), "baseline_row_px", "x_height_top_row_px")
    good = G.band_quality(good.join(band, [*PAGE, "tier", "line"], "left")).drop("line_box", "baseline_row_px", "x_height_top_row_px")
    if tokens is not None:
        known = lines.select(*PAGE, F.lit("transcribed").alias("tier"), F.col("candidate").alias("line"), "source", F.col("text").alias("_text")).join(line_styles(tokens), [*PAGE, "source"])
        good = good.join(known, [*PAGE, "tier", "line"], "left")
        good = good.withColumn("style", style_at(F.col("spans"), word_start(F.col("_text"), F.col("word")) + F.col("glyph"))).drop("spans", "_text", "source")
    else:
        good = good.withColumn("style", F.lit(None).cast("string"))
    order = ["project_id", "page_name", "tier", "line", "word", "glyph"]
    flagged = G.unlike_flagged(G.flagged(good, [*PAGE, "tier", "line"], [*PAGE, "tier", "line", "word"]), order)
    return {
        "cuts": cuts.filter("reason is not null").groupBy("tier", "reason").agg(F.count(F.lit(1)).alias("words")), "glyphs": flagged, "coverage": G.coverage(good), "atlas": P.atlas(good, ["tier", "style", "character"]),
        "x_height": lines.groupBy(*PAGE).agg(F.when(F.count("x_height_px") >= 5, half_up(F.median("x_height_px"))).alias("x_height_px")),
    }

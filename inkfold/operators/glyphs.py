"""Coverage, references and quality flags of cut characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions.text import code_point, middle

from .pooling import ranked_values
from .selection import first_n

#: Fixed values.
X_HEIGHT_LETTERS = "acemnorsuvwxz"
ASCENDERS = "bdfhklt"
MIN_WIDTH_SAMPLES = 30
MIN_LINE_SAMPLES = 4
NARROW, WIDE, OVERTALL, FLAT = 0.6, 1.5, 1.35, 1.10
SPARSE, TOLERANCE = 0.15, 1
SHAPE_LEAST, SHAPE_MOST, SHAPE_RATIO = 60, 250, 1.4
#: Flags that say a glyph may be wrong; the others only describe it.
DEFECTS = ("flat_ascender", "narrow", "overtall", "unlike_character", "wide")
SHEET_CELLS, SHEET_COLUMNS = 1024, 32


def coverage(glyphs: DataFrame) -> DataFrame:
    """Counts by (tier, style, character), by tier and style, and by tier, in one pass."""
    sets = glyphs.groupingSets([["tier", "style", "character"], ["tier", "style"], ["tier"]], "tier", "style", "character")
    return sets.agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n")).withColumn("label", code_point(F.col("character")))


def width_references(glyphs: DataFrame) -> DataFrame:
    """character, style, reference: median width where enough samples stand."""
    return glyphs.groupBy("character", "style").agg(F.median("width").alias("reference"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= MIN_WIDTH_SAMPLES).drop("_n")


def x_height_references(glyphs: DataFrame, keys: list[str], least: int = MIN_LINE_SAMPLES) -> DataFrame:
    """keys, x_reference: median height of x-height letters where enough stand."""
    small = glyphs.filter(F.col("character").isin(*X_HEIGHT_LETTERS))
    return small.groupBy(*keys).agg(F.median("height").alias("x_reference"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).drop("_n")


def band_quality(glyphs: DataFrame) -> DataFrame:
    """Adds ink_density, row_extent_px, top_offset_px, bottom_offset_px and `band_flags` to glyphs(box, ink, line_box, baseline_row_px,
    x_height_top_row_px). A glyph without a measured line has its density alone."""
    b, line = F.col("box"), F.col("line_box")
    density = F.col("ink") / ((b["x1"] - b["x0"]) * (b["y1"] - b["y0"]))
    known = line.isNotNull() & F.col("baseline_row_px").isNotNull() & F.col("x_height_top_row_px").isNotNull()
    top, bottom = F.when(known, b["y0"] - F.col("x_height_top_row_px")), F.when(known, b["y1"] - 1 - F.col("baseline_row_px"))
    flags = {
        "ascends": top < -TOLERANCE, "descends": bottom > TOLERANCE, "short_of_baseline": bottom < -TOLERANCE, "sparse_ink": density < F.lit(SPARSE),
        "touches_line_bottom": known & (b["y1"] >= line["y1"]), "touches_line_top": known & (b["y0"] <= line["y0"]),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))
    return glyphs.withColumns({"ink_density": density, "row_extent_px": b["y1"] - b["y0"], "top_offset_px": top, "bottom_offset_px": bottom, "band_flags": found})


def flagged(glyphs: DataFrame, line: list[str], word: list[str] | None = None) -> DataFrame:
    """Adds sorted `flags`: narrow and wide by the character's width, overtall by its line's x-height letters; with `word` (keys)
    also flat_ascender on all characters of a word whose ascenders are flat. Flags in a column `band_flags` are taken in.

    References have a row for each character and style, or line; an absent style is a style of its own.
    """
    widths = width_references(glyphs).withColumnsRenamed({"character": "_c", "style": "_s"})
    rows = glyphs.join(widths, (F.col("character") == F.col("_c")) & F.col("style").eqNullSafe(F.col("_s")), "left").drop("_c", "_s")
    rows = rows.join(x_height_references(glyphs, line), line, "left")
    tall = F.col("character").isin(*X_HEIGHT_LETTERS) & (F.col("height") >= F.lit(OVERTALL) * F.col("x_reference"))
    flags: list[Column] = [F.when(F.col("width") < F.lit(NARROW) * F.col("reference"), "narrow"), F.when(tall, "overtall"), F.when(F.col("width") >= F.lit(WIDE) * F.col("reference"), "wide")]
    if word:
        flat = ascender_flatness(glyphs, word).filter("flat").select(*word, F.lit("flat_ascender").alias("_flat"))
        rows = rows.join(flat, word, "left")
        flags.append(F.col("_flat"))
    found = F.array_compact(F.array(*flags))
    found = F.concat(found, "band_flags") if "band_flags" in glyphs.columns else found
    return rows.withColumn("flags", F.array_sort(F.array_distinct(found))).drop("_flat")


def shape_references(glyphs: DataFrame, order: list[str], least: int = SHAPE_LEAST, most: int = SHAPE_MOST) -> DataFrame:
    """character, style, median (array of a grid's cells, cut to whole numbers) and scatter of characters with enough samples.

    glyphs: character, style, flags, grid (array of numbers). The sample are the first `most` without a defect in row order, which
    a bounded ranking keeps before they move; a cell's median and the distances from the medians are computed on that sample.
    """
    sound = glyphs.filter(~F.arrays_overlap("flags", F.array(*[F.lit(f) for f in DEFECTS])) & F.col("grid").isNotNull())
    sample = first_n(sound, ["character", "style"], [F.col(c) for c in order], most)
    told = sample.groupBy("character", "style").agg(F.collect_list("grid").alias("_g")).filter(F.size("_g") >= least)
    cells = F.transform(F.sequence(F.lit(0), F.size(F.get("_g", F.lit(0))) - 1), lambda i: middle(F.transform("_g", lambda g: F.get(g, i))))
    told = told.withColumn("_m", cells)
    away = F.array_sort(F.transform("_g", lambda g: grid_distance(g, F.col("_m"))))
    at = F.least(F.size("_g") - 1, F.floor(F.lit(0.95) * F.size("_g")).cast("int"))
    return told.select("character", "style", F.transform("_m", lambda x: F.floor(x).cast("int")).alias("median"), F.get(away, at).alias("scatter"))


def grid_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two grids, as a share of a cell's range."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)) / 255


def unlike_flagged(glyphs: DataFrame, order: list[str], references: DataFrame | None = None) -> DataFrame:
    """glyphs with unlike_character among its flags where a grid lies beyond SHAPE_RATIO times its character's scatter."""
    refs = (references or shape_references(glyphs, order)).select(F.col("character").alias("_c"), F.col("style").alias("_s"), "median", "scatter")
    rows = glyphs.join(refs, (F.col("character") == F.col("_c")) & F.col("style").eqNullSafe(F.col("_s")), "left")
    far = (F.col("scatter") > 0) & (grid_distance(F.col("grid"), F.col("median")) > F.lit(SHAPE_RATIO) * F.col("scatter"))
    more = F.array_sort(F.array_distinct(F.concat("flags", F.array(F.lit("unlike_character")))))
    return rows.withColumn("flags", F.when(F.coalesce(far, F.lit(False)), more).otherwise(F.col("flags"))).drop("_c", "_s", "median", "scatter")


def ascender_flatness(glyphs: DataFrame, word: list[str]) -> DataFrame:
    """word keys, flatness, flat: tallest ascender over the median x-height letter, where a word has both."""
    tall = F.max(F.when(F.col("character").isin(*ASCENDERS), F.col("height")))
    small = F.median(F.when(F.col("character").isin(*X_HEIGHT_LETTERS), F.col("height")))
    out = glyphs.groupBy(*word).agg(tall.alias("_t"), small.alias("_m")).filter("_t is not null and _m > 0")
    return out.select(*word, (F.col("_t") / F.col("_m")).alias("flatness"), (F.col("_t") / F.col("_m") < F.lit(FLAT)).alias("flat"))


def sheets(glyphs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds sheet, row and column of each glyph's atlas cell, by its place among its key's glyphs in `order`.

    The first column of the order (the page) deals a key's glyphs out: they are counted by page, the counts are summed up over a
    key's pages, and glyphs are numbered within their page, so a frequent character is in no task as a whole.
    """
    page = [*keys, order[0]]
    counts = glyphs.groupBy(*page).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(page)], before.alias("_before"))
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(page)]
    rows = glyphs.withColumn("_i", F.row_number().over(Window.partitionBy(*page).orderBy(*order[1:])) - 1).join(starts, on)
    rows = rows.withColumn("_at", F.col("_before") + F.col("_i"))
    inside = F.col("_at") % SHEET_CELLS
    out = rows.withColumns({"sheet": F.floor(F.col("_at") / SHEET_CELLS).cast("int"), "cell_row": F.floor(inside / SHEET_COLUMNS).cast("int"), "cell_column": (inside % SHEET_COLUMNS).cast("int")})
    return out.drop("_at", "_i", "_before", *[f"_k{i}" for i in range(len(page))])


def cell_extent(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cell_width, cell_height: the values at 95 % of the sorted widths and heights."""
    at = F.least(F.col("_all") - 1, F.floor(F.lit(0.95) * F.col("_all")))
    w, h = (ranked_values(glyphs, keys, c, {f"cell_{c}": at}) for c in ("width", "height"))
    right = h.withColumnsRenamed({k: f"_{k}" for k in keys})
    return w.join(right, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).select(*keys, "cell_width", "cell_height")

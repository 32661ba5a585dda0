"""Page shapes that a book repeats, and the class of each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions.text import is_recto

from .pooling import median_mad

#: Fixed values, in pixels and shares.
HEAD_MAD_MAX = 25
HEAD_WINDOW_MIN = 8
HEAD_WINDOW_FACTOR = 3
CHAPTER_SINK_MIN = 150
SIDE_SHARE_MIN = 0.2


def head_windows(pages: DataFrame) -> DataFrame:
    """book, center, spread, n, window (null where the first band wanders too much for any template)."""
    mad = median_mad(pages, ["book"], "first_top")
    return mad.withColumn("window", F.when(F.col("spread") <= HEAD_MAD_MAX, F.greatest(F.lit(float(HEAD_WINDOW_MIN)), HEAD_WINDOW_FACTOR * F.col("spread"))))


def head_ordinal(tops: Column, center: Column, window: Column) -> Column:
    """The first band at or below the head window, as a place in `tops` (array, in order); 0 where all lie above it."""
    first = F.array_min(F.filter(F.transform(tops, lambda t, i: F.when(t >= center - window, i)), lambda i: i.isNotNull()))
    return F.coalesce(first, F.lit(0))


def fit_templates(pages: DataFrame) -> DataFrame:
    """book, page_class, first_top, first_spread, text_left, text_right, band_count, page_count, page_share of the classes that a
    book shows; page_share is of all pages of the book given.

    pages: book, page_name, first_top, text_left, text_right, band_count. Everything is grouped aggregation by book; the books' centers,
    one row each, are joined back.
    """
    rows = pages.withColumn("_recto", is_recto(F.col("page_name"))).join(head_windows(pages).select("book", F.col("center").alias("_c"), "window"), "book").filter("window is not null")
    normal = rows.filter(F.abs(F.col("first_top") - F.col("_c")) <= F.col("window"))
    sunk = rows.filter(F.col("first_top") - F.col("_c") >= CHAPTER_SINK_MIN).withColumn("page_class", F.lit("chapter_opening"))
    middle = normal.groupBy("book").agg(F.median("text_left").alias("_mid"))
    normal = normal.join(middle, "book").withColumn("_low", F.col("text_left") <= F.col("_mid"))
    share = lambda side: F.coalesce(F.avg(F.when(side, F.col("_recto").cast("int"))), F.lit(0.0))
    sides = normal.groupBy("book").agg(
        F.count_if("_low").alias("_nl"), F.count_if(~F.col("_low")).alias("_nh"), (share(~F.col("_low")) > share(F.col("_low"))).alias("_high_recto")
    )
    normal = normal.join(sides, "book")
    by_name = F.least("_nl", "_nh") < F.lit(SIDE_SHARE_MIN) * (F.col("_nl") + F.col("_nh"))
    recto = F.when(by_name, F.col("_recto")).when(F.col("_high_recto"), ~F.col("_low")).otherwise(F.col("_low"))
    normal = normal.withColumn("page_class", F.when(recto, "normal_recto").otherwise("normal_verso"))
    shown = ["book", "page_class", "first_top", "text_left", "text_right", "band_count"]
    both = normal.select(*shown).unionByName(sunk.select(*shown))
    tops = median_mad(both, ["book", "page_class"], "first_top")
    edges = both.groupBy("book", "page_class").agg(*[F.median(c).cast("int").alias(c) for c in ("text_left", "text_right", "band_count")])
    total = pages.groupBy("book").agg(F.count(F.lit(1)).alias("_total"))
    out = tops.join(edges, ["book", "page_class"]).join(total, "book")
    return out.select("book", "page_class", F.col("center").cast("int").alias("first_top"), F.col("spread").cast("int").alias("first_spread"), "text_left", "text_right", "band_count", F.col("n").alias("page_count"), (F.col("n") / F.col("_total")).alias("page_share"))


def classify(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """book, page, page_class, residual, confidence of pages by their head band.

    pages: book, page, first_top, head_top, text_left. The book's center and window are those of its first bands.
    """
    wide = templates.groupBy("book").pivot("page_class", ["normal_recto", "normal_verso", "chapter_opening"]).agg(F.first(F.struct("first_top", "first_spread", "text_left")))
    rows = pages.join(head_windows(pages).select("book", "center", "window"), "book").join(wide, "book", "left")
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("text_left") - F.col(f"{c}.text_left")).alias("off"), F.lit(c).alias("c"), F.col(c).alias("t")))
    best = F.array_min(F.array_compact(F.array(near("normal_recto"), near("normal_verso"))))
    offset = F.col("head_top") - F.col("center")
    rows = rows.withColumn("_b", F.when((F.abs(offset) <= F.col("window")) & (best["off"] <= F.col("window")), best))
    sunk = (F.abs(offset) > F.col("window")) & (offset >= CHAPTER_SINK_MIN) & F.col("chapter_opening").isNotNull()
    t = F.when(F.col("_b").isNotNull(), F.col("_b.t")).when(sunk, F.col("chapter_opening"))
    residual = F.abs(F.col("head_top") - t["first_top"]).cast("int")
    confidence = F.greatest(F.lit(0.0), 1 - residual / F.greatest(t["first_spread"], F.lit(HEAD_WINDOW_MIN)))
    return rows.select("book", "page", F.when(F.col("_b").isNotNull(), F.col("_b.c")).when(sunk, "chapter_opening").otherwise("unknown").alias("page_class"), residual.alias("residual"), confidence.alias("confidence"))

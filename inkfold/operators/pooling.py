"""Robust pooling: exact medians with their spread, evidence and exclusions, over one or two stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions.text import deviation, middle


def median_mad(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, center, spread, n: exact median and median absolute deviation, nulls left out.

    Rows are counted by value where they are; only distinct values move, and center and spread are read off their counts.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    center = F.percentile("_v", F.lit(0.5), F.col("_n")).over(Window.partitionBy(*keys))
    out = counts.withColumn("_c", center).groupBy(*keys).agg(F.first("_c").alias("center"), F.percentile(F.abs(F.col("_v") - F.col("_c")), F.lit(0.5), F.col("_n")).alias("spread"), F.sum("_n").alias("n"))
    return out.select(*keys, "center", "spread", "n")


def pool_estimate(rows: DataFrame, keys: list[str], value: str, page: Column, exclusion: Column, order: Column) -> DataFrame:
    """One estimate a group: value, spread, sample_count, the pages it rests on and `page:code` of those left out, in order.

    An estimate names its pages, so a group's pages meet once, with their values, and everything is read off them.
    """
    entry = F.struct(order.alias("o"), page.alias("p"), exclusion.alias("x"), F.col(value).cast("double").alias("v"))
    told = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    used = F.filter("_all", lambda e: e["x"].isNull() & e["v"].isNotNull())
    told = told.withColumn("_used", used).withColumn("_values", F.transform("_used", lambda e: e["v"]))
    exclusions = F.transform(F.filter("_all", lambda e: e["x"].isNotNull()), lambda e: F.concat_ws(":", e["p"], e["x"]))
    evidence = F.transform("_used", lambda e: e["p"])
    return told.select(*keys, F.size("_used").cast("long").alias("sample_count"), evidence.alias("evidence"), exclusions.alias("exclusions"), middle(F.col("_values")).alias("value"), deviation(F.col("_values")).alias("mad"))


def page_medians(lines: DataFrame, keys: list[str], metrics: dict[str, tuple[Column, str]]) -> DataFrame:
    """keys (a page's), name, value, line_sample_count, excluded_line_count and missing_reason, a row for each metric of each page.

    A metric is an array of a line's values, empty where the line has none, and the reason given where no line of a page has any.
    A page's lines are few, so they meet once.
    """
    aggs = [x for n, (v, _) in metrics.items() for x in (F.flatten(F.collect_list(v)).alias(f"v_{n}"), F.count_if(F.size(v) > 0).alias(f"n_{n}"))]
    pages = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_lines"), *aggs)
    told = [
        F.struct(F.lit(n).alias("name"), middle(F.col(f"v_{n}")).alias("value"), F.col(f"n_{n}").alias("line_sample_count"), (F.col("_lines") - F.col(f"n_{n}")).alias("excluded_line_count"), F.when(F.size(f"v_{n}") == 0, F.lit(code)).alias("missing_reason"))
        for n, (_, code) in metrics.items()
    ]
    return pages.select(*keys, F.inline(F.array(*told)))


def one(value: Column) -> Column:
    """A metric of single values: an array of one, or of none."""
    return F.when(value.isNotNull(), F.array(value.cast("double"))).otherwise(F.array().cast("array<double>"))


def pool_pages(pages: DataFrame, book: str, style: str) -> DataFrame:
    """Medians of page_medians(book, page, style) for each book and for each style in it, in one pass with grouping sets.

    Returns book, style (null: the whole book), name, value, sample_count (pages) and line_sample_count; a name without any
    value keeps its row.
    """
    sets = pages.groupingSets([[book, "name"], [book, style, "name"]], book, style, "name")
    out = sets.agg(F.grouping(style).alias("_whole"), F.median("value").alias("value"), F.count("value").alias("sample_count"), F.sum("line_sample_count").alias("line_sample_count"))
    return out.filter((F.col("_whole") == 1) | F.col(style).isNotNull()).drop("_whole")


def two_stage(lines: DataFrame, book: str, page: str, style: str, metrics: dict[str, Column]) -> DataFrame:
    """pool_pages of the page medians of single values."""
    return pool_pages(page_medians(lines, [book, page, style], {n: (one(c), "no_value") for n, c in metrics.items()}), book, style)


def unpooled(pages: DataFrame, book: str, page: str, style: str, order: Column) -> DataFrame:
    """book, style, exclusions: for each style of a book, `page:unpooled_page_class` of its pages of another style or none, in order.

    Such lists name pages, so a book's pages meet."""
    rows = pages.select(book, page, style).distinct()
    styles = rows.filter(F.col(style).isNotNull()).select(F.col(book).alias("_b"), F.col(style).alias("_s")).distinct()
    others = rows.join(styles, F.col(book) == F.col("_b")).filter(~F.col(style).eqNullSafe(F.col("_s")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(page).alias("p")))), lambda e: F.concat(e["p"], F.lit(":unpooled_page_class")))
    found = others.groupBy("_b", "_s").agg(listed.alias("exclusions"))
    out = styles.join(found, ["_b", "_s"], "left").select(F.col("_b").alias(book), F.col("_s").alias(style), F.coalesce("exclusions", F.array().cast("array<string>")).alias("exclusions"))
    return out


def ranked_values(rows: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """keys and, for each name, the value that stands at that index (a column of `_all`, the number of rows) of the sorted values.

    Values are counted before they move; what is sorted in a group are its distinct values.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    counts = counts.withColumn("_upto", F.sum("_n").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(group))
    return counts.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") > at, F.col("_v"))).alias(n) for n, at in places.items()])


def dispersion(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, p16, p84 by nearest rank."""
    at = lambda share: F.floor(F.lit(share) * (F.col("_all") - 1) + F.lit(0.5))
    return ranked_values(rows, keys, value, {"p16": at(0.16), "p84": at(0.84)})

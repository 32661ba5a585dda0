"""Histograms, exact thresholds and valleys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD_GAP_CLAMP = 64
MIN_GAPS = 64
VALLEY_SPLIT = 0.5


def clamped(rows: DataFrame, keys: list[str], value: str, most: int = WORD_GAP_CLAMP) -> DataFrame:
    """keys, level, n."""
    return rows.groupBy(*keys, F.least(F.col(value), F.lit(most)).cast("long").alias("level")).agg(F.count(F.lit(1)).alias("n"))


def otsu(hist: DataFrame, keys: list[str]) -> DataFrame:
    """keys, threshold: the lowest level that maximises the variance between classes.

    Between-class variance is (w1 * S - W * s1)^2 / (w1 * (W - w1)). The difference is exact in decimals; the variance is a
    double, and levels whose variances are equal to 12 digits count as tied, of which the lowest is taken. Raster histograms,
    where exactness to the last digit matters, go through kernels.raster. A histogram with one level gives 0. hist has a row a
    level, so groups are small.
    """
    w = Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*keys)
    d = lambda c: c.cast("decimal(18,0)")
    c = hist.withColumns({"_w": d(F.sum("n").over(w)), "_s": d(F.sum(F.col("n") * F.col("level")).over(w)), "_wt": d(F.sum("n").over(everything)), "_st": d(F.sum(F.col("n") * F.col("level")).over(everything))})
    diff = (F.col("_w") * F.col("_st")).cast("decimal(24,0)") - (F.col("_wt") * F.col("_s")).cast("decimal(24,0)")
    c = c.withColumns({"_d": diff.cast("decimal(24,0)"), "_n1": F.col("_w"), "_n2": F.col("_wt") - F.col("_w")}).filter("_n1 > 0 and _n2 > 0")
    c = c.withColumn("_v", F.pow(F.col("_d").cast("double"), 2) / (F.col("_n1").cast("double") * F.col("_n2").cast("double")))
    c = c.withColumn("_best", F.max("_v").over(everything)).filter("_v >= _best * (1 - 1e-12D)")
    found = c.groupBy(*keys).agg(F.min("level").alias("threshold"))
    return hist.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("threshold", F.lit(0)).cast("long").alias("threshold"))

"""Ink bands that are no lines of type, by their ink and height against the other bands of their page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values, in percent: a speck's ink and height at most, a rule's height at most and density over.
SPECK_INK, SPECK_HEIGHT = 5, 31
RULE_HEIGHT, RULE_DENSITY = 50, 60


def band_reasons(bands: DataFrame, keys: list[str]) -> DataFrame:
    """bands(keys, ink, height, area) with `reason`: speck_band, rule_band or null. Shares are compared in whole numbers."""
    middle = bands.groupBy(*keys).agg(F.median("ink").alias("_ink"), F.median("height").alias("_height"))
    low = (F.col("_height") <= 0) | (F.col("height") * 100 <= F.col("_height") * SPECK_HEIGHT)
    speck = (F.col("_ink") > 0) & low & (F.col("ink") * 100 < F.col("_ink") * SPECK_INK)
    rule = (F.col("_height") > 0) & (F.col("height") * 100 <= F.col("_height") * RULE_HEIGHT) & (F.col("area") > 0) & (F.col("ink") * 100 > F.col("area") * RULE_DENSITY)
    return bands.join(middle, keys).withColumn("reason", F.when(speck, "speck_band").when(rule, "rule_band")).drop("_ink", "_height")

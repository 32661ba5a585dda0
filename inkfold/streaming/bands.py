"""Ink bands of a stream of rows as session windows. An addition: pages need no streams, but gap-joined ranges are sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_bands(events: DataFrame, key: str, time: str, gap: str = "20 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, stop, n: stretches of events no further apart than `gap`; rows later than `late` are let go on a stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")

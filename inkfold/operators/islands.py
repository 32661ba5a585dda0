"""Gaps and islands: runs of ordered positions that lie close together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(keys: list[str], position: str):
    return Window.partitionBy(*keys).orderBy(position)


def gaps(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """keys, position, gap: the empty positions before each, where there are any."""
    back = F.col(position) - F.lag(position).over(_order(keys, position)) - 1
    return rows.select(*keys, position, back.alias("gap")).filter("gap > 0")


def runs(rows: DataFrame, keys: list[str], position: str, split: Column, at_least: int = 1) -> DataFrame:
    """keys, run (from 0), start, stop (half open), size: a run ends where `split` or more positions are empty.

    rows hold the occupied positions only. Runs that span under at_least positions are left out, before they are numbered.
    """
    w = _order(keys, position)
    back = F.col(position) - F.lag(position).over(w) - 1
    marked = rows.withColumn("_b", F.when(back.isNull() | (back >= split), 1).otherwise(0))
    marked = marked.withColumn("_g", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(*keys, "_g").agg(F.min(position).alias("start"), (F.max(position) + 1).alias("stop"), F.count(F.lit(1)).alias("size"))
    out = out.filter(F.col("stop") - F.col("start") >= at_least)
    return out.withColumn("run", F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1).drop("_g")


def since_last(rows: DataFrame, keys: list[str], position: str, blank: Column, stop: Column) -> DataFrame:
    """Adds `blank_since`: blank rows since the last row that meets `stop`."""
    w = _order(keys, position)
    total = F.sum(F.when(blank, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_t", total).withColumn("_stop", stop)
    last = F.last(F.when(F.col("_stop"), F.col("_t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("blank_since", F.col("_t") - F.coalesce(last, F.lit(0))).drop("_t", "_stop")

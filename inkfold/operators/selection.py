"""Ranking, bounded top-k and coverage-first selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, where: Column | None = None) -> DataFrame:
    """The first n rows of each key among those that meet `where`; others don't use up the allowance."""
    rows = df if where is None else df.filter(where)
    return ranked(rows, keys, order, "_n").filter(F.col("_n") <= n).drop("_n")


def positions(df: DataFrame, leading: list[Column], order: list[Column], name: str = "position") -> DataFrame:
    """Adds each row's place, from 1, in the order of `leading`, then `order`, over the whole table.

    Rows are counted by their leading values, the counts, a row a value, are summed up in order, and rows are numbered among those
    with the same leading values; so no window goes over all rows.
    """
    keys = [f"_l{i}" for i in range(len(leading))]
    rows = df.select("*", *[c.alias(k) for c, k in zip(leading, keys, strict=True)])
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(k).alias(f"_s{k}") for k in keys], before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = rows.withColumn("_i", inside).join(starts, [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in keys])
    return out.withColumn(name, F.col("_before") + F.col("_i")).drop("_i", "_before", *keys, *[f"_s{k}" for k in keys])


def coverage_first(pages: DataFrame, keys: list[str], name: str, order: list[Column], groups: tuple[str, ...], k: int) -> DataFrame:
    """At most k rows a key, with their `position`: for each group in turn its best row not yet taken, then the best of the rest.

    pages needs an array column `groups`; `order` are values that ascend (negate numbers to descend). A group's choice lies among
    its first len(groups) rows, and the rest among the first k + len(groups) of all: one bounded ranking by group, with a group
    of all rows, keeps these before they move, in one pass over pages, and what meets in a key is bounded.
    """
    order_key = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)]).alias("_o")
    rows = pages.select(*keys, name, "groups", order_key).withColumn("_g", F.explode(F.concat(F.array(F.lit("")), "groups")))
    some = first_n(rows, [*keys, "_g"], [F.col("_o")], k + len(groups))
    entry = F.struct(F.col("_o").alias("r"), F.col(name).alias("name"), F.col("groups").alias("groups"))
    all_of = some.groupBy(*keys).agg(F.array_sort(F.collect_set(entry)).alias("_all"))

    def take(taken: Column, group: Column) -> Column:
        fits = F.filter("_all", lambda e: F.array_contains(e["groups"], group) & ~F.array_contains(taken, e["name"]))
        return F.slice(F.concat(taken, F.transform(F.slice(fits, 1, 1), lambda e: e["name"])), 1, k)

    all_of = all_of.withColumn("_t", F.aggregate(F.array(*[F.lit(x) for x in groups]), F.array().cast("array<string>"), take))
    rest = F.transform(F.filter("_all", lambda e: ~F.array_contains(F.col("_t"), e["name"])), lambda e: e["name"])
    chosen = F.slice(F.concat("_t", rest), 1, k)
    return all_of.select(*keys, F.posexplode(chosen).alias("position", name)).withColumn("position", F.col("position") + 1)

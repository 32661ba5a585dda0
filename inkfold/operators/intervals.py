"""Joins of boxes and intervals on one page: equal page keys with a geometric condition, never a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two half-open intervals share, zero at least."""
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def area_share(word: str, box: str) -> Column:
    """Twice the area of the word inside the box, less the word's area: not negative when half lies inside."""
    c = lambda t, x: F.col(f"{t}.{x}").cast("long")
    inside = overlap(c(word, "x0"), c(word, "x1"), c(box, "x0"), c(box, "x1")) * overlap(c(word, "y0"), c(word, "y1"), c(box, "y0"), c(box, "y1"))
    return 2 * inside - (c(word, "x1") - c(word, "x0")) * (c(word, "y1") - c(word, "y0"))


def contained(words: DataFrame, boxes: DataFrame, how: str = "inner") -> DataFrame:
    """Words joined with the boxes of their page that hold half of their area or more; left_anti gives those in no box."""
    on = (F.col("w.page") == F.col("b.page")) & (area_share("w", "b") >= 0)
    out = words.alias("w").join(boxes.alias("b"), on, how)
    return out if how == "left_anti" else out.select("w.*", "b.box_id")


def best_overlap(runs: DataFrame, words: DataFrame) -> DataFrame:
    """For each run (box_id, page, box) the word (word_id, page, box) that shares the most columns with it, among those that share
    over 0.4 of their own height with its rows; ties go to the smaller word_id. At most one row a run."""
    rows = overlap(F.col("w.y0"), F.col("w.y1"), F.col("b.y0"), F.col("b.y1"))
    cols = overlap(F.col("w.x0"), F.col("w.x1"), F.col("b.x0"), F.col("b.x1"))
    on = (F.col("w.page") == F.col("b.page")) & (rows * 10 > (F.col("w.y1") - F.col("w.y0")) * 4) & (cols > 0)
    met = words.alias("w").join(runs.alias("b"), on).select("b.box_id", "b.page", "w.word_id", cols.alias("shared"))
    best = met.groupBy("box_id", "page").agg(F.max(F.struct("shared", (-F.col("word_id")).alias("o"))).alias("m"))
    return best.select("box_id", "page", (-F.col("m.o")).alias("word_id"), F.col("m.shared").alias("shared"))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """a joined with b on keys where the half-open spans overlap, with the shared part as cut_start, cut_stop."""
    right = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = (F.col(b_span[0]) < F.col(a_span[1])) & (F.col(b_span[1]) > F.col(a_span[0]))
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    return a.join(right, on).drop(*[f"_{k}" for k in keys]).withColumns({"cut_start": F.greatest(a_span[0], b_span[0]), "cut_stop": F.least(a_span[1], b_span[1])})


def merged(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes whose column ranges overlap, directly or through others, as one: keys, x0, x1, y0, y1, n.

    A sweep by left edge: a box beyond the greatest right edge so far opens a new group.
    """
    w = Window.partitionBy(*keys).orderBy("x0", "x1")
    edge = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = boxes.withColumn("_new", F.when(edge.isNull() | (F.col("x0") >= edge), 1).otherwise(0))
    marked = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n")).drop("_g")


def joined_pieces(boxes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, `name` and cluster (its smallest `name`) of boxes(keys, name, x0, y0, x1, y1) that stand side by side at one height, or
    are linked through others: kernels.components.joinable by group. A group is a page's band, so it is small."""
    import pandas as pd

    from inkfold.kernels.components import Blob, joined_roots

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blobs = [Blob((r.x0, r.y0, r.x1, r.y1), i, 1, 0) for i, r in enumerate(pdf.itertuples(index=False))]
        names = pdf[name].to_numpy()
        group = joined_roots(blobs)
        least: dict[int, int] = {}
        for i, g in enumerate(group):
            least[g] = min(least.get(g, names[i]), names[i])
        return pdf[[*keys, name]].assign(cluster=[least[g] for g in group])

    kinds = dict(boxes.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, name]) + f", cluster {kinds[name]}"
    return boxes.groupBy(*keys).applyInPandas(run, schema)

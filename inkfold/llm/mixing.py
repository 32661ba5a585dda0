"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target comes from its weight and a cap of MAX_COPIES times its own size. The expected copies of each of its
documents are target / source_size. The whole part is allocated to every document for certain; the rest is a fixed-size
sample, the size counted in words: documents are ranked by random odds u/(1-u) over their inclusion odds, and the ranking is
taken until the remaining words are reached, to the nearest document. Inclusion odds are those of the fraction left, tilted
by the square root of a document's size over the source's mean size (bounded by TILT), so probabilities are unequal.

u comes from the md5 of the seed and doc_id, so reruns agree. The cut is found in two steps: sizes are summed by source and
range of the ranking key, and only the one range that holds a source's cut is ranked row by row. Ranges are equal parts of what
the key is without its inclusion odds, which spreads evenly but for the bounded tilt whatever the target; a source has one for
each BUCKET_ROWS of its documents, so a range holds TILT times as many at most, by chance, and no task gets a source's rows. The
one unpartitioned window runs over a row a source.

Defined results: null text has size 0; null sources are one source, last in the weights' order; documents of size 0 take 0
words; with equal keys the smaller doc_id, then the smaller size goes first, and rows equal in all of these are
interchangeable. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, words, written

MAX_COPIES = 3
WEIGHTS = 3
#: Documents of a source for each range of its ranking key, and the most ranges.
BUCKET_ROWS, MOST_BUCKETS = 256, 1 << 20
TILT = 4.0
SEED = "inkfold-mix"


def source_targets(sizes: DataFrame, weights: int = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, n_docs -> + target. Weights 1, 2, ... repeat in code-point order of the sources, null last.

    The caps are reached in the order of cap/weight, so the level that shares the total is found in one ordered pass: after
    the k first sources are capped it is (total - their caps) / (weights left), and the first k whose level caps no more
    is the answer, the same that resharing the excess again and again ends with.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    t = sizes.withColumn("_w", (F.pmod(F.row_number().over(by_name) - 1, F.lit(weights)) + 1).cast("double"))
    t = t.withColumn("_cap", F.col("source_size").cast("double") * max_copies).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    left = total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    t = t.withColumn("_level", left / weight)
    t = t.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(everything)["_level"])
    return t.select("source", "source_size", "n_docs", F.least("_cap", F.col("_level") * F.col("_w")).alias("target"))


def filed(rows: DataFrame, part: Column) -> DataFrame:
    """rows(_u, size, source_size, n_docs) with _key, by which they are ranked for the fraction `part`, and _bucket, its range."""
    mean = F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1.0))
    tilt = F.least(F.greatest(F.sqrt(F.col("size") / mean), F.lit(1 / TILT)), F.lit(TILT))
    odds = part / (1 - part)
    rows = rows.withColumn("_key", (F.col("_u") / (1 - F.col("_u"))) / (odds * tilt))
    even, ranges = F.col("_key") * odds, F.least(F.ceil(F.col("n_docs") / BUCKET_ROWS), F.lit(MOST_BUCKETS))
    return rows.withColumn("_bucket", F.floor(even / (1 + even) * ranges))


def mixed(docs: DataFrame, keep_rows: bool = False, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of each document; with keep_rows also the whole row as _doc."""
    rows = docs.select(F.struct("*").alias("_doc"), "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    rows = written((rows if keep_rows else rows.drop("_doc")).withColumn("_u", u), "sizes")
    targets = written(source_targets(written(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), "source-sizes")), "targets")
    rows = join_small(rows, targets, "source", F.col("doc_id"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("_whole", F.floor(rate)).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    rows = filed(rows, F.greatest(rate - F.col("_whole"), F.lit(1e-9)))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"), F.max("_rest").alias("_rest"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = sums.withColumn("_before", before).filter("_before + _sum > _rest").groupBy("source").agg(F.min(F.struct("_bucket", "_before")).alias("_cut"))
    rows = join_small(rows, written(cuts, "cuts"), "source", F.col("doc_id"))
    at_cut = F.col("_bucket") == F.col("_cut._bucket")
    away = rows.filter(~F.coalesce(at_cut, F.lit(False))).withColumn("_take", F.col("_cut").isNull() | (F.col("_bucket") < F.col("_cut._bucket")))
    ranked = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.filter(at_cut).withColumn("_take", F.col("_cut._before") + F.coalesce(F.sum("size").over(ranked), F.lit(0)) + F.col("size") / 2 <= F.col("_rest"))
    rows = away.unionByName(cut).withColumn("copies", F.least(F.col("_whole") + F.when(F.col("_take"), 1).otherwise(0), F.lit(MAX_COPIES)).cast("int"))
    return rows.withColumn("taken", F.col("copies") * F.col("size")).drop("_u", "_whole", "_rest", "_key", "_bucket", "_cut", "_take")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: a row a document."""
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def take_mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    return mixed(docs, keep_rows=True).filter("copies > 0").select("_doc", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_copy")).select("_doc.*")


ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) size,
  (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / {1 << 48}::DOUBLE u FROM documents),
s AS (SELECT source, sum(size)::BIGINT source_size, count(*) n_docs FROM d GROUP BY source),
s2 AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {WEIGHTS} + 1)::DOUBLE w, (source_size * {MAX_COPIES})::DOUBLE cap FROM s),
s3 AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(w) FROM s2) - coalesce(sum(w) OVER b, 0)) lvl, cap / w ratio FROM s2
  WINDOW b AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT source, source_size, n_docs, least(cap, w * (SELECT arg_min(lvl, ratio) FROM s3 WHERE lvl <= ratio)) target FROM s3),
e AS (SELECT d.*, source_size, n_docs, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0::DOUBLE END rate FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
e2 AS (SELECT *, floor(rate)::BIGINT whole, target - floor(rate) * source_size rest, greatest(rate - floor(rate), 1e-9::DOUBLE) part,
  least(greatest(sqrt(size::DOUBLE / greatest(source_size::DOUBLE / n_docs, 1::DOUBLE)), {1 / TILT}::DOUBLE), {TILT}::DOUBLE) tilt FROM e),
e3 AS (SELECT *, (u / (1::DOUBLE - u)) / (part / (1::DOUBLE - part) * tilt) key FROM e2),
e4 AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size::DOUBLE / 2 <= rest take FROM e3),
e5 AS (SELECT *, least(whole + CASE WHEN take THEN 1 ELSE 0 END, {MAX_COPIES})::INTEGER copies FROM e4)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT taken, copies FROM e5
"""

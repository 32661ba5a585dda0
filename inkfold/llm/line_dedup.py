"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

Every line is hashed, a rolling polynomial over the last WINDOW line hashes is taken at each line, and a chunk ends where it
is less than at the REACH lines before and no more than at the REACH after (and at the end of the text). Boundaries depend on
the lines around them only, so an inserted line shifts none of those that follow, and they lie over REACH lines apart; none lies
within MIN_LINES of a text's ends, so no chunk of a text of several lines is a single line. Chunks of MIN_LINES non-blank lines
or more that stand in several places are removed everywhere but at the first (by doc_id, then place in the document).

Chunk hashes are counted slim, without text. Only documents with a repeated hash are carried on; their chunks are then grouped
by the text itself, which is the byte comparison: a hash alone never removes a line. The joins are plain equi joins of written
tables, so a passage that a third of the documents share is split by adaptive skew handling, and counts are summed before they
move. The joins are sort-merge joins at every size: a plan that changes with the input would say little about a larger one.

Defined results: null text has no lines and stays null; an empty text has one empty line; rows equal in doc_id and text are
one document, each row gets the same result; a null doc_id comes after all others, and equal doc_ids follow their text's hash.
An empty table gives an empty table. Other columns are carried in one struct, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 3
BASE = 33
REACH = 2
MIN_LINES = 2
SPACE = " \t\x0b\x0c\r"


def _lined(docs: DataFrame, *more: Column) -> DataFrame:
    rows = docs.select(*more, "doc_id", "text", F.xxhash64("doc_id", "text").alias("_ref"), F.split("text", "\n").alias("_l"))
    rows = rows.withColumn("_v", F.transform("_l", lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long")))
    roll = F.transform("_v", lambda x, i: sum((F.coalesce(F.get("_v", i - k), F.lit(0)) * BASE**k for k in range(1, WINDOW)), x))
    rows = rows.withColumn("_r", roll).drop("_v")
    last = F.size("_l") - 1

    def least(i: Column) -> Column:
        own, holds = F.get("_r", i), (i >= MIN_LINES - 1) & (i <= last - MIN_LINES)
        for k in range(1, REACH + 1):
            holds &= F.coalesce(own < F.get("_r", i - k), F.lit(True)) & F.coalesce(own <= F.get("_r", i + k), F.lit(True))
        return holds

    rows = rows.withColumn("_e", F.when(F.size("_l") > 0, F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | least(i)))).drop("_r")
    return rows.withColumn("_c", F.transform("_e", lambda e, k: F.struct(k.alias("k"), F.when(k == 0, 0).otherwise(F.get("_e", k - 1) + 1).alias("a"), e.alias("b")))).drop("_e")


def _text(c: Column) -> Column:
    return F.array_join(F.slice(F.col("_l"), c["a"] + 1, c["b"] - c["a"] + 1), "\n")


def _solid(c: Column) -> Column:
    return F.size(F.filter(F.slice(F.col("_l"), c["a"] + 1, c["b"] - c["a"] + 1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)) >= MIN_LINES


def deduplicated(docs: DataFrame, keep_rows: bool = False) -> DataFrame:
    """doc_id, n_lines, n_chunks, n_removed, kept_text of each row; with keep_rows also the whole row as _doc."""
    chunks = _lined(docs).select("_ref", F.explode(F.filter("_c", lambda c: (c["b"] - c["a"] + 1 >= MIN_LINES) & _solid(c))).alias("c"), "_l")
    chunks = written(chunks.select("_ref", F.col("c.k").alias("k"), F.xxhash64(_text(F.col("c"))).alias("h")), "chunks")
    places = chunks.distinct()
    again = places.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    live = written(places.join(again.hint("merge"), "h").groupBy("_ref").agg(F.collect_set("k").alias("_ks")), "live")  # at most a document's chunks
    rows = _lined(docs, *([F.struct("*").alias("_doc")] if keep_rows else [])).withColumnRenamed("_ref", "_r")
    rows = written(rows.join(live.hint("merge"), rows["_r"] == live["_ref"], "left").drop("_ref", "text"), "lined")  # the lines hold the text
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_r").alias("r"), F.col("c.k").alias("k"))
    texts = rows.filter("_ks is not null").select("doc_id", "_r", "_l", F.explode(F.filter("_c", lambda c: F.array_contains("_ks", c["k"]))).alias("c")).select("_r", F.col("c.k").alias("k"), _text(F.col("c")).alias("t"), order.alias("o"))
    texts = written(texts, "texts")
    first = written(texts.groupBy("t").agg(F.min("o").alias("first")), "first").withColumnRenamed("t", "t2")
    gone = texts.join(first.hint("merge"), F.col("t") == F.col("t2")).filter("o <> first").groupBy("_r").agg(F.collect_set("k").alias("_gone")).withColumnRenamed("_r", "_g")
    flagged = rows.filter("_ks is not null").join(written(gone, "gone").hint("merge"), F.col("_r") == F.col("_g"), "left").drop("_g")
    rows = flagged.unionByName(rows.filter("_ks is null").withColumn("_gone", F.lit(None).cast("array<int>")))
    left = F.filter("_c", lambda c: ~F.coalesce(F.array_contains("_gone", c["k"]), F.lit(False)))
    rows = rows.withColumn("_left", F.flatten(F.transform(left, lambda c: F.slice("_l", c["a"] + 1, c["b"] - c["a"] + 1))))
    n = lambda x: F.when(F.col(x).isNull(), 0).otherwise(F.size(x)).cast("long")
    return rows.select(
        *(["_doc"] if keep_rows else []), "doc_id", n("_l").alias("n_lines"), n("_c").alias("n_chunks"), (n("_l") - n("_left")).alias("n_removed"),
        F.array_join("_left", "\n").alias("kept_text"),
    )


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_chunks, n_removed, kept_md5: a row a document."""
    return deduplicated(docs).select("doc_id", "n_lines", "n_chunks", "n_removed", F.md5("kept_text").alias("kept_md5"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, text, string_split(text, chr(10)) l FROM documents),
x AS (SELECT rid, unnest(range(0, len(l))) i, unnest(l) line, len(l) n FROM d),
v AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT v FROM x),
r AS (SELECT *, {" + ".join(f"coalesce(lag(v, {k}) OVER w, 0) * {BASE**k}" for k in range(WINDOW))} r FROM v WINDOW w AS (PARTITION BY rid ORDER BY i)),
b AS (SELECT *, (i = n - 1 OR (i >= {MIN_LINES - 1} AND i <= n - 1 - {MIN_LINES} AND {" AND ".join(f"coalesce(r < lag(r, {k}) OVER w, true) AND coalesce(r <= lead(r, {k}) OVER w, true)" for k in range(1, REACH + 1))}))::INT e FROM r WINDOW w AS (PARTITION BY rid ORDER BY i)),
k AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) k FROM b),
c AS (SELECT rid, k, string_agg(line, chr(10) ORDER BY i) t, count(*) m, count_if(regexp_matches(line, '[^\\x20\\x09-\\x0D]')) solid FROM k GROUP BY rid, k),
o AS (SELECT c.*, doc_id, row_number() OVER (PARTITION BY t ORDER BY doc_id, rid, k) r FROM c JOIN d USING (rid)),
g AS (SELECT *, (m >= {MIN_LINES} AND solid >= {MIN_LINES} AND r > 1) gone FROM o),
a AS (SELECT rid, sum(m)::BIGINT n_lines, count(*) n_chunks, coalesce(sum(m) FILTER (gone), 0)::BIGINT n_removed, coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (NOT gone), '') t FROM g GROUP BY rid)
SELECT d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_chunks, 0) n_chunks, coalesce(n_removed, 0) n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE md5(t) END kept_md5 FROM d LEFT JOIN a USING (rid)
"""

"""Quality rules with host-level verdicts, in DataFrame functions only.

Every document is measured by itself. Failures of each soft rule are summed by host (the `source` column), the host's
failure rate is shrunk toward the corpus rate with a beta prior fitted to the spread of the hosts' rates by the method of
moments, and the shrunk rate goes back to the documents: a soft failure weighs 1/2 plus its host's shrunk rate, and a
document whose failures weigh 1 or more is rejected. So one soft failure rejects a document only on a host where most
documents fail that rule; two reject it anywhere. Documents without any soft failure are never rejected by their host.

Defined results: null or empty text has no words (n_words 0, base_failed). Null sources are one host. Repeated rows each
get their own, equal result. An empty table gives an empty table. Windows of three words are told apart within a document
by 64-bit hashes. Other columns of the input are carried in one struct, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, words, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Soft rules, by name: a condition on the measures.
SOFT = {
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars > 12 * n_words OR 2 * word_chars < 5 * n_words",
    "repeats": "100 * n_repeat_words > 20 * n_words",
}
#: Bounds of the prior's strength, in documents.
PRIOR_MIN, PRIOR_MAX = 1.0, 10_000.0
REJECT_WEIGHT = 1.0


def _less(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measured(docs: DataFrame) -> DataFrame:
    """_doc (the whole row), doc_id, source and the measures of each document."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    rows = docs.select(F.struct("*").alias("_doc"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    rows = rows.select("_doc", "_text", words(text).alias("_w"), lines.alias("_lines"))
    rows = rows.select(
        "_doc",
        F.size("_w").cast("long").alias("n_words"),
        (F.length(text) - _less(text, " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        _less(text, SYMBOLS).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)),
        ).alias("_h"),
    )
    rows = rows.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    ).drop("_h")
    twice = F.filter("_s", lambda s, k: (F.get("_s", k - 1)["h"] == s["h"]) | (F.get("_s", k + 1)["h"] == s["h"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))))
    rows = rows.withColumn("n_repeat_words", F.when(F.col("_s").isNull(), 0).otherwise(covered).cast("long")).drop("_s")
    return rows.select(
        "*",
        F.col("_doc")["doc_id"].alias("doc_id"),
        F.col("_doc")["source"].alias("source"),
        F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words").alias("base_failed"),
        *[F.expr(f"n_words > 0 AND ({rule})").alias(f"soft_{name}") for name, rule in SOFT.items()],
    )


def host_rates(rows: DataFrame) -> DataFrame:
    """source, n_docs, and for each soft rule the shrunk rate rate_<rule>: one row a host."""
    hosts = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.count_if(F.col(f"soft_{r}")).alias(f"f_{r}") for r in SOFT]
    )
    hosts = written(hosts, "hosts")
    prior = hosts.agg(
        *[(F.sum(f"f_{r}") / F.sum("n_docs")).alias(f"m_{r}") for r in SOFT],
        *[F.var_pop(F.col(f"f_{r}") / F.col("n_docs")).alias(f"v_{r}") for r in SOFT],
    )
    hosts = hosts.join(F.broadcast(prior))  # one row
    rates = []
    for r in SOFT:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        strength = F.when(v > 0, F.least(F.greatest(m * (1 - m) / v - 1, F.lit(PRIOR_MIN)), F.lit(PRIOR_MAX))).otherwise(F.lit(PRIOR_MAX))
        rates.append(((F.col(f"f_{r}") + m * strength) / (F.col("n_docs") + strength)).alias(f"rate_{r}"))
    return hosts.select("source", "n_docs", *rates)


def judged(docs: DataFrame, keep_rows: bool = False) -> DataFrame:
    """The measures, base_failed and kept of each document; with keep_rows also the whole row as _doc."""
    rows = measured(docs)
    rows = written(rows if keep_rows else rows.drop("_doc"), "measured")
    hosts = written(host_rates(rows), "host-rates").drop("n_docs")
    out = join_small(rows, hosts, "source", F.col("doc_id"))
    weight = sum((F.when(F.col(f"soft_{r}"), 0.5 + F.col(f"rate_{r}")).otherwise(0.0) for r in SOFT), F.lit(0.0))
    return out.withColumn("kept", ~F.col("base_failed") & (weight < REJECT_WEIGHT))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept: a row a document."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, with its columns, that the rules keep."""
    return judged(docs, keep_rows=True).filter("kept").select("_doc.*")


ORACLE = f"""
WITH t AS (SELECT row_number() OVER () rid, doc_id, source, coalesce(text, '') text FROM documents),
w AS (SELECT rid, unnest(range(1, len(l) + 1)) i, unnest(l) w FROM (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') l FROM t)),
n AS (SELECT rid, count(*) n_words, sum(length(w)) word_chars FROM w GROUP BY rid),
g AS (SELECT rid, i, w, lead(w) OVER p w2, lead(w, 2) OVER p w3 FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
g2 AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w2, w3) c FROM g WHERE w3 IS NOT NULL) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT j) n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) j FROM g2) GROUP BY rid),
s AS (SELECT rid, length(text) - length(translate(text, '{SYMBOLS}', '')) n_symbols FROM t),
l AS (SELECT rid, count(*) n_lines, count(*) - count(DISTINCT line) n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
m AS (SELECT t.rid, doc_id, source, coalesce(n_words, 0) n_words, coalesce(word_chars, 0)::BIGINT word_chars, n_symbols,
  coalesce(n_lines, 0) n_lines, coalesce(n_dup_lines, 0) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words
  FROM t LEFT JOIN n USING (rid) LEFT JOIN r USING (rid) LEFT JOIN s USING (rid) LEFT JOIN l USING (rid)),
f AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) base_failed,
  {", ".join(f"(n_words > 0 AND ({rule})) soft_{r}" for r, rule in SOFT.items())} FROM m),
h AS (SELECT source, count(*) n_docs, {", ".join(f"count_if(soft_{r}) f_{r}" for r in SOFT)} FROM f GROUP BY source),
p AS (SELECT {", ".join(f"sum(f_{r}) / sum(n_docs) m_{r}, var_pop(f_{r} / n_docs) v_{r}" for r in SOFT)} FROM h),
k AS (SELECT h.*, {", ".join(f"m_{r}, CASE WHEN v_{r} > 0 THEN least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, {PRIOR_MIN}), {PRIOR_MAX}) ELSE {PRIOR_MAX} END k_{r}" for r in SOFT)} FROM h, p)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
  NOT f.base_failed AND {" + ".join(f"CASE WHEN soft_{r} THEN 0.5 + (f_{r} + m_{r} * k_{r}) / (n_docs + k_{r}) ELSE 0 END" for r in SOFT)} < {REJECT_WEIGHT} AS kept
FROM f JOIN k ON f.source IS NOT DISTINCT FROM k.source
"""

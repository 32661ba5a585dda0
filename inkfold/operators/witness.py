"""What a recogniser says of matched lines: the word at a line's first ink run, and how many lines it explains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.functions.text import letters_only

from .intervals import best_overlap

PAGE = ["project_id", "page_name"]


def numbered(words: DataFrame) -> DataFrame:
    """words with page (project and name) and word_id, their order within a page by line and word."""
    return words.withColumns({"page": F.struct(*PAGE), "word_id": F.col("line_index").cast("long") * (1 << 20) + F.col("word_index")})


def first_runs(lines: DataFrame, words: DataFrame) -> DataFrame:
    """lines with first_run_text, first_run_confidence, first_run_matches_source and continuation_fragment.

    lines: project_id, page_name, candidate, text, first_run (box or null), word_run_count, source_word_count. words:
    sources.corpus.witness_words. A line has a fragment where it shows more runs than words and its first run reads otherwise than
    its first word; a run that no word overlaps has no reading and is no fragment.
    """
    runs = lines.filter("first_run is not null").select(F.col("candidate").alias("box_id"), F.struct(*PAGE).alias("page"), "first_run.*")
    said = numbered(words).select("page", "word_id", "word", "confidence", "box.*")
    best = best_overlap(runs, said.select("page", "word_id", "x0", "y0", "x1", "y1"))
    read = best.join(said.select("page", "word_id", "word", "confidence"), ["page", "word_id"]).select(
        F.col("page.project_id").alias("_p"), F.col("page.page_name").alias("_n"), F.col("box_id").alias("_c"), F.col("word").alias("first_run_text"), F.col("confidence").alias("first_run_confidence")
    )
    rows = lines.join(read, (F.col("project_id") == F.col("_p")) & (F.col("page_name") == F.col("_n")) & (F.col("candidate") == F.col("_c")), "left").drop("_p", "_n", "_c")
    own = F.get(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != ""), F.lit(0))
    same = letters_only(F.col("first_run_text")) == letters_only(own)
    split = F.col("word_run_count") > F.col("source_word_count")
    return rows.withColumns({"first_run_matches_source": same, "continuation_fragment": F.coalesce(split & ~same, F.lit(False))})


def tallies(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measured, witnessed, continuation_fragments, reconciled_after_witness and its share of the measured lines (null
    without any): lines that agree as they stand, or with their first run, a fragment, left out."""
    agrees = F.col("words_reconciled") | (F.col("continuation_fragment") & (F.col("word_run_count") - 1 == F.col("source_word_count")))
    out = lines.groupBy(*keys).agg(
        F.count_if("measured").alias("measured"),
        F.count("first_run_text").alias("witnessed"),
        F.count_if("continuation_fragment").alias("continuation_fragments"),
        F.count_if(F.coalesce(agrees, F.lit(False))).alias("reconciled_after_witness"),
    )
    return out.withColumn("reconciled_share", F.try_divide("reconciled_after_witness", "measured"))

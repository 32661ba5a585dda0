"""Acceptance gates, review categories and yields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the acceptance gate.
MIN_LINES, MAX_LINES = 4, 80
MATCHED_RATIO_MIN = 0.90
COUNT_DIFFERENCE_SHARE = 0.10
COUNT_DIFFERENCE_MIN = 2
COST_MAX = 0.22
UNIQUENESS_MIN = 0.15
PRECISION_MIN = 0.98
ADMITTED_LINES_MIN = 30
AGREEMENT_MIN = 0.8
#: Codes of the gate, before and after alignment.
LINE_COUNT, COUNT_DIFFERENCE = "line_count_out_of_range", "line_count_difference_exceeds_maximum"
RATIO, COST, UNIQUENESS = "matched_ratio_below_minimum", "normalized_cost_exceeds_maximum", "uniqueness_margin_below_minimum"


def count_exclusions(lines: Column, candidates: Column) -> Column:
    """Codes that are known before any alignment."""
    most = F.greatest(F.lit(COUNT_DIFFERENCE_MIN), F.ceil(F.lit(COUNT_DIFFERENCE_SHARE) * lines))
    return F.array_compact(
        F.array(
            F.when((lines < MIN_LINES) | (lines > MAX_LINES), LINE_COUNT),
            F.when(F.abs(lines - candidates) > most, COUNT_DIFFERENCE),
        )
    )


def quality_exclusions(matched: Column, lines: Column, cost: Column, uniqueness: Column) -> Column:
    ratio = F.when(lines > 0, matched / lines).otherwise(0.0)
    return F.array_compact(
        F.array(
            F.when(ratio < MATCHED_RATIO_MIN, RATIO),
            F.when(cost > COST_MAX, COST),
            F.when(uniqueness < UNIQUENESS_MIN, UNIQUENESS),
        )
    )


def gate(inherited: Column, counts: Column, quality: Column) -> tuple[Column, Column]:
    """(exclusions in order, state): any code before alignment excludes a page, only quality codes leave it proposed."""
    early = F.array_distinct(F.concat(inherited, counts))
    state = F.when(F.size(early) > 0, "excluded").when(F.size(quality) > 0, "proposed").otherwise("accepted")
    return F.array_distinct(F.concat(early, quality)), state


def category(exclusions: Column, changed: list[str], unavailable: list[str], complex_: list[str]) -> Column:
    """Review category by priority; a code in no list is an error."""
    lit = lambda x: F.array(*[F.lit(v) for v in x])
    unknown = F.array_except(exclusions, lit([*changed, *unavailable, *complex_]))
    return (
        F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown exclusion "), F.array_join(unknown, ","))).cast("string"))
        .when(F.arrays_overlap(exclusions, lit(changed)), "source_changed")
        .when(F.arrays_overlap(exclusions, lit(unavailable)), "unavailable")
        .when(F.arrays_overlap(exclusions, lit(complex_)), "complex")
        .otherwise("eligible")
    )


def review_summary(reviewed: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, precision and coverage of reviewed lines (accepted, correct, complex booleans); null where nothing counts."""
    out = reviewed.groupBy(*keys).agg(
        F.count_if(F.col("accepted") & F.col("correct")).alias("accepted_correct"),
        F.count_if(F.col("accepted") & ~F.col("correct")).alias("accepted_wrong"),
        F.count_if(~F.col("accepted") & F.col("correct")).alias("rejected_correct"),
        F.count_if(~F.col("accepted") & ~F.col("correct")).alias("rejected_wrong"),
        F.count_if(F.col("accepted") & F.col("complex")).alias("complex_accepted"),
    )
    accepted = F.col("accepted_correct") + F.col("accepted_wrong")
    every = accepted + F.col("rejected_correct") + F.col("rejected_wrong")
    out = out.withColumns({"precision": F.try_divide("accepted_correct", accepted), "coverage": F.try_divide(accepted, every)})
    return out.withColumn("passes", F.coalesce(F.col("precision") >= PRECISION_MIN, F.lit(False)) & (F.col("complex_accepted") == 0))


def book_yield(projects: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Eligible and accepted pages of every project, those without pages included."""
    counts = pages.groupBy(key).agg(F.count_if("eligible").alias("eligible"), F.count_if(F.col("eligible") & F.col("accepted")).alias("accepted"))
    out = projects.join(counts, key, "left").fillna(0, ["eligible", "accepted"])
    return out.withColumns({"coverage": F.try_divide("accepted", "eligible"), "admitted": F.col("accepted") >= ADMITTED_LINES_MIN})

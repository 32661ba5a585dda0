"""The queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from . import decontaminate, license_scan, line_dedup, lm_score, mixing, quality_classifier, quality_rules, simhash, substring_dedup, token_output
from .common import documents


def queries():
    return {
        "op1_simhash": lambda spark, d: simhash.near_duplicates(documents(spark, d)),
        "op2_token_output": lambda spark, d: token_output.token_output(documents(spark, d)),
        "op3_license_scan": lambda spark, d: license_scan.license_scan(documents(spark, d)).drop("blocks"),
        "op4_lm_score": lambda spark, d: lm_score.lm_score(documents(spark, d)),
        "op5_quality_classifier": lambda spark, d: quality_classifier.quality_classifier(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
        "op6_decontaminate": lambda spark, d: decontaminate.leaks(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
        "op7_substring_dedup": lambda spark, d: substring_dedup.substring_dedup(documents(spark, d)),
        "op8_mixing": lambda spark, d: mixing.mix(documents(spark, d)),
        "op9_quality_rules": lambda spark, d: quality_rules.quality_rules(documents(spark, d)),
        "op10_line_dedup": lambda spark, d: line_dedup.line_dedup(documents(spark, d)),
    }


def oracle_sql():
    return {"op8_mixing": mixing.ORACLE, "op9_quality_rules": quality_rules.ORACLE, "op10_line_dedup": line_dedup.ORACLE}

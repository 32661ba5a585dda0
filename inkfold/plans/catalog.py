"""Named queries over the tables at hand, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_boxes, q_glyphs, q_kernels, q_lines, q_pages, q_scalars

_PARTS = (q_pages, q_lines, q_boxes, q_glyphs, q_scalars, q_kernels)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for part in _PARTS for name, (run, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}

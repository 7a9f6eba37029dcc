"""Names of the core queries, their callables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bindery.plans import QUERIES, SQL
from bindery.plans import acquire_queries, detect_queries, extra_queries, front_queries, hierarchy_queries, mapping_queries, metadata_queries, page_queries, parse_queries, plan_queries, report_queries, scalar_queries, section_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    h = hierarchy_queries
    return {"p2_found": h.p2_found, "p2_paths": h.p2_paths, "p2_descendants": h.p2_descendants, "p2_descendants_all": h.p2_descendants_all} | QUERIES


def oracle_sql() -> dict[str, str]:
    return hierarchy_queries.SQL | SQL


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: which contents entries resolve to which physical page, counted."""
    return QUERIES["mapping_status_counts"](spark, d)

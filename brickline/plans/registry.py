"""All registered queries of the library's own operators, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brickline.plans import catalogue_queries, export_queries, guess_queries, line_queries, log_queries, match_queries, slice_queries, tally_queries

MODULES = (catalogue_queries, match_queries, line_queries, guess_queries, tally_queries, export_queries, log_queries, slice_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: f for m in MODULES for n, f in m.QUERIES.items()}
ORACLE: dict[str, str] = {n: sql for m in MODULES for n, sql in m.ORACLE.items()}

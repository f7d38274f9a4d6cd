"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixlake.plans import annotation_queries, interval_queries, read_queries, sequence_queries, source_queries

FAMILIES = (interval_queries, read_queries, annotation_queries, sequence_queries, source_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for f in FAMILIES for k, v in f.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for f in FAMILIES for k, v in f.ORACLES.items()}

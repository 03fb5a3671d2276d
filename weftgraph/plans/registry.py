"""Queries over the driver's tables and the SQL that says the same, by family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.plans import extract_queries, graph_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**graph_queries.QUERIES, **text_queries.QUERIES, **extract_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**graph_queries.SQL, **text_queries.SQL, **extract_queries.SQL}

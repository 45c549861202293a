"""All queries of the address engine, by name, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plotline.plans import apply_queries, catalog_queries, chain_queries, element_queries, match_queries, polygon_queries, quality_queries, reader_queries, review_queries, source_queries, stand_in_queries, text_queries, validation_queries

FLAGSHIP = "bucket_assign"
MODULES = (apply_queries, catalog_queries, chain_queries, element_queries, match_queries, polygon_queries, text_queries, quality_queries, reader_queries, review_queries, source_queries, stand_in_queries, validation_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}

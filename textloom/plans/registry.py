"""All queries of the library's own operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import classify, curation, dedup, maths, tokens

_FAMILIES = (curation, dedup, classify, tokens, maths)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for family in _FAMILIES for name, (query, _) in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in _FAMILIES for name, (_, sql) in family.QUERIES.items() if sql is not None}

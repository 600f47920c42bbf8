"""All queries of the engine's own operators, with the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import counts, editions, lookups, reviews, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in (counts, lookups, texts, reviews, editions):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL

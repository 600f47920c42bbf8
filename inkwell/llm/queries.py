"""The queries of this subpackage and their DuckDB SQL, gathered from its modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact, mixing, packing, pii, quality, rules, simhash, substring, tokens, toxicity

MODULES = [exact, substring, mixing, tokens, simhash, toxicity, quality, pii, packing, rules]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: q for m in MODULES for k, q in m.SQL.items()}

"""Every registered query of the library, with its SQL for DuckDB, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codetables.queries import cards, graphs, operations, search, trees

_MODULES = (search, trees, graphs, operations, cards)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
FLAGSHIP = "knn_topk"

"""The registered queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_MODULES = ("text_queries", "web_queries", "model_queries", "vector_queries", "conversation_queries")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql.strip()
        return function
    return add


def load() -> None:
    for name in _MODULES:
        importlib.import_module(f"fieldframe.llm.{name}")

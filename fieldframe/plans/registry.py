"""Registry of named queries with the SQL that states the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.plans.tables import VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Rounding used on both sides of a comparison. The offset is not one half, so that short
# decimal results never lie on the boundary between two rounded values.
_OFFSET = 0.4876543


def snap(value: Column, digits: int = 6) -> Column:
    """Round to a number of decimals, the same way in both engines."""
    scale = 10.0 ** digits
    rounded = F.floor(value * scale + _OFFSET).cast("double") / scale
    return F.when(F.isnan(value), value).otherwise(rounded)


def sql_snap(value: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"(CASE WHEN isnan({value}) THEN {value} ELSE floor(({value})*{scale}+{_OFFSET})/{scale} END)"


def number(value: float) -> str:
    """A double literal; the exponent keeps the SQL engine from reading a decimal."""
    text = repr(float(value))
    return text if "e" in text else text + "e0"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``views`` are the derived tables its SQL refers to."""
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
            text = sql.strip()
            if ctes:
                text = f"WITH {ctes}, {text[5:]}" if text.upper().startswith("WITH ") else f"WITH {ctes} {text}"
            # the field component "by" is also a keyword, which these texts write in capitals
            SQL[name] = re.sub(r'(?<!")\bby\b(?!")', '"by"', text)
        return function
    return add

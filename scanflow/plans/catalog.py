"""Registry of runnable queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _rounded(value: str | Column, alias: str | None, digits: int) -> Column:
    """Rounding that two engines agree on: values that end in a bare 5 go up on both sides."""
    scale = float(10**digits)
    col = F.col(value) if isinstance(value, str) else value
    name = alias or (value if isinstance(value, str) else None)
    out = F.floor(col.cast("double") * F.lit(scale) + F.lit(0.5001)) / F.lit(scale)
    return out.alias(name) if name else out


def r6(value: str | Column, alias: str | None = None) -> Column:
    return _rounded(value, alias, 6)


def r4(value: str | Column, alias: str | None = None) -> Column:
    return _rounded(value, alias, 4)


def expand_rounding(sql: str) -> str:
    """Write ``r6(x)`` and ``r4(x)`` out as the SQL of ``r6`` / ``r4``."""
    found = re.search(r"\br([46])\(", sql)
    if not found:
        return sql
    depth, end = 1, found.end()
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[end], 0)
        end += 1
    inner = expand_rounding(sql[found.end() : end - 1])
    scale = f"1e{found.group(1)}::DOUBLE"
    text = f"(floor(CAST(({inner}) AS DOUBLE) * {scale} + 0.5001::DOUBLE) / {scale})"
    return sql[: found.start()] + text + expand_rounding(sql[end:])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = expand_rounding(sql)
        return fn

    return register

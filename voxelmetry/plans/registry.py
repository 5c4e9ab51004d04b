"""Registers every query with, where SQL can say it, the same question as plain SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxelmetry.sources.views import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Decorator: ``fn(tables) -> DataFrame`` becomes ``queries()[name]``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return wrap


def uniform_sql(seed: int, *keys: str) -> str:
    """``hash_uniform`` as SQL."""
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496::DOUBLE)"


def with_views(sql: str) -> str:
    """Puts the view definitions that ``sql`` uses in front of it; ``sql`` may start with its own CTEs."""
    used: list[str] = []

    def visit(text: str) -> None:
        for view, body in SQL_VIEWS.items():
            if view not in used and re.search(rf"\b{view}\b", text):
                visit(body)
                if view not in used:
                    used.append(view)

    visit(sql)
    body = sql.strip()
    if not used:
        return body if body.upper().startswith("SELECT") else "WITH RECURSIVE " + body
    head = "WITH RECURSIVE " + ",\n".join(f"{v} AS ({SQL_VIEWS[v]})" for v in used)
    return head + ("\n" if body.upper().startswith("SELECT") else ",\n") + body

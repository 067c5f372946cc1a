"""Registry of named queries and their SQL statements.

Statements are assembled from named common table expressions: `statement(body)` puts every
expression that `body` mentions, directly or through another one, in front of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BODIES: dict[str, str] = {}
CTES: dict[str, str] = {}
_NAME = re.compile(r"\bv_\w+")


def cte(name: str, body: str) -> None:
    if name in CTES:
        raise ValueError(f"{name} is already defined")
    CTES[name] = body


def statement(body: str) -> str:
    ordered: list[str] = []

    def visit(text: str, own: str | None) -> None:
        for name in _NAME.findall(text):
            if name != own and name in CTES and name not in ordered:
                visit(CTES[name], name)
                ordered.append(name)

    visit(body, None)
    parts = []
    for name in ordered:
        recursive = re.search(rf"\b{name}\b", CTES[name]) is not None
        parts.append(f"{name} AS {'' if recursive else 'MATERIALIZED '}(\n{CTES[name].strip()}\n)")
    head = "WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else ""
    return head + body.strip()


def query(key: str, sql: str | None = None):
    def register(fn):
        if key in QUERIES:
            raise ValueError(f"{key} is already registered")
        QUERIES[key] = fn
        if sql is not None:
            BODIES[key] = sql
        return fn
    return register


def R(expr: str) -> str:
    """Six decimals without negative zero, as numeric.r6 does."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"

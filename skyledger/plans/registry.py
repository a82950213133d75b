"""Queries by name, each with the SQL that gives the same rows (None where SQL cannot express it)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir) -> DataFrame``."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add

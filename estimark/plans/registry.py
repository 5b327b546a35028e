"""Registry of named queries: Spark builder + optional DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from estimark.plans.oracle_bindings import with_blocks

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, blocks: list[str] | None = None, sql: str | None = None, recursive: bool = False):
    """Register ``fn(spark, sf_dir)`` as ``name``; ``sql`` (with ``blocks``
    put into a WITH clause) is its oracle.  No ``sql`` means rows-only."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_blocks(blocks, sql, recursive) if blocks else sql
        return fn

    return deco

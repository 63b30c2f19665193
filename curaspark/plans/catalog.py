"""Registry of the named queries and the SQL text each is compared with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}

AREAS = [
    "evaluation",
    "answers",
    "proposals",
    "assembly",
    "rewards",
    "user_rewards",
    "advantages",
    "tokens",
    "metrics",
    "batches",
    "similarity",
    "runs",
    "files",
    "images",
    "streams",
]


def query(name: str, sql: str | None = None, doubles: tuple[str, ...] = ()) -> Callable[[QueryFn], QueryFn]:
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is the text DuckDB runs on the same tables.

    ``doubles`` names columns that DuckDB would give as decimals, because the SQL writes them as decimal literals.
    """
    if sql is not None and doubles:
        sql = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in doubles)}) FROM ({sql})"

    def register(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return register


def _load() -> None:
    for area in AREAS:
        importlib.import_module(f"curaspark.plans.{area}")


def all_queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)

"""Named queries and their SQL. A query is a function of the session and the folder of the tables."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered already")
        _QUERIES[name] = f
        if oracle:
            _SQL[name] = oracle
        return f

    return put


def called(f: Callable, arguments: dict) -> object:
    """Call a named operator with what it knows of the arguments; unknown names and nulls are left out."""
    known = inspect.signature(f).parameters
    return f(**{k: v for k, v in arguments.items() if k in known and v is not None})


def _load() -> None:
    from . import corpus_queries, findings_queries, registry_queries, scalar_queries, scoring_queries, session_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

"""Registry of queries: each module of ``MODULES`` adds entries with ``query(name, sql)``."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ["graphloom.plans.q_relational", "graphloom.plans.q_graph", "graphloom.plans.q_index"]

_QUERIES: dict[str, Callable] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``f(spark, sf_dir) -> DataFrame`` as ``name``, with the SQL that must give the same rows."""

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLE[name] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(m)


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)

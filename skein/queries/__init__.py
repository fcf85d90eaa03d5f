"""Registered queries: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("text", "graph", "search", "retrieval", "resolution", "evaluation", "serialization", "stores", "incremental")
_found: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def keep(f):
        _found[name] = f, sql
        return f

    return keep


def all_queries() -> dict[str, tuple[Callable, str | None]]:
    for m in MODULES:
        importlib.import_module(f"skein.queries.{m}")
    return dict(_found)

"""Registered queries: name → (spark builder, DuckDB oracle SQL or None).

Every builder takes (spark, sf_dir) and reads the driver tables, so its
work grows with them.  Oracle SQL runs on DuckDB views of the same tables.
Names follow SURVEY §2 ids.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}

_MODULES = ("flagship", "scans", "columns", "joins", "aggs", "ordered", "reshape", "calib", "text",
            "learn", "ratings", "streams")


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[Callable, str | None]]:
    for m in _MODULES:
        importlib.import_module(f"tessera.registry.{m}")
    return REGISTRY

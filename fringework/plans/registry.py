"""Registered queries of the engine and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: Modules of this package that register queries; each has QUERIES and ORACLE_SQL.
MODULES: tuple[str, ...] = ("pixels", "combining", "shapes", "arrays", "scalars", "products", "files")


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for name in MODULES:
        out.update(importlib.import_module(f"fringework.plans.{name}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(importlib.import_module(f"fringework.plans.{name}").ORACLE_SQL)
    return out

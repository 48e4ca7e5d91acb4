"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("simhash", "mixing", "bpe", "chat", "webp", "warc", "licenses", "toxicity", "url_filters", "fingerprints")


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for name in MODULES:
        out.update(importlib.import_module(f"{__package__}.{name}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(importlib.import_module(f"{__package__}.{name}").ORACLE_SQL)
    return out

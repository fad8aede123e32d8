"""All queries of the library. Importing the modules registers them."""

from __future__ import annotations

import importlib

from loomline.plans.registry import QUERIES, SQL, Query

MODULES = ("relational", "text", "search", "archive", "content", "listing", "repair")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"loomline.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return QUERIES


def sql() -> dict[str, str]:
    _load()
    return SQL

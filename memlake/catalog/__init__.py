"""Named queries over the given tables, one or more per operator."""

from __future__ import annotations

import importlib

from memlake.catalog.base import ORACLES, QUERIES, Query

_MODULES = ("search", "texts", "backlog", "code", "history", "assembly", "upkeep")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"memlake.catalog.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)

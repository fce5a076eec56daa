"""All queries of the subpackage; importing the modules registers them."""

from __future__ import annotations

from memlake.llm import model_queries, native_queries  # noqa: F401
from memlake.llm.base import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)

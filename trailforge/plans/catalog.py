"""Queries over the test tables and the SQL that checks them, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name, with the SQL for its rows where there is one."""

    def add(run):
        QUERIES[run.__name__] = run
        if oracle:
            ORACLES[run.__name__] = oracle
        return run

    return add


for _module in ("tagging", "relations", "routing", "places"):
    importlib.import_module(f"trailforge.plans.{_module}")

"""All registered queries of the core library."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ravelin.plans import cohorts, oracles, relational, studies

#: Functions of those modules that queries are made of.
PARTS = {"design", "dense", "paired_design"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By name: those that SQL checks, then the studies."""
    found = {name: getattr(relational, name) for name in oracles.oracle_sql()}
    for module in (cohorts, studies):
        own = {name: f for name, f in vars(module).items() if inspect.isfunction(f) and f.__module__ == module.__name__ and not name.startswith("_") and name not in PARTS}
        found |= {name: f for name, f in own.items() if list(inspect.signature(f).parameters)[:2] == ["spark", "sf"]}
    return found


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | cohorts.oracle_sql()

"""The operators bound to the driver's tables: queries by name, and DuckDB SQL written apart from them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["stars", "tenants", "scalars", "rankings", "diffs", "states", "reporting", "texts", "graphs", "selections", "sources", "streams"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"tarnbeck.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

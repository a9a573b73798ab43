"""Queries of the operators' modules. Each module has QUERIES: name -> (function of spark and sf_dir, DuckDB SQL or None)."""

from __future__ import annotations

import importlib

MODULES = ("aggregates", "slices", "usage", "maintenance", "listing", "upkeep", "benchmark", "population", "imports", "reports", "insights", "local_kpis", "dedup_index", "raw_review", "cubes")


def _all() -> dict:
    found: dict = {}
    for module in MODULES:
        found |= importlib.import_module(f"{__package__}.{module}").QUERIES
    return found


def queries() -> dict:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}

"""Collects the queries of every operator module."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    import repairlens.plans as home

    for info in sorted(pkgutil.iter_modules(home.__path__), key=lambda m: m.name):
        if info.name.startswith("q_"):
            yield importlib.import_module(f"{home.__name__}.{info.name}")


def queries() -> dict:
    """name -> function(spark, sf_dir) -> DataFrame."""
    return {name: run for module in _modules() for name, run in module.QUERIES.items()}


def oracle_sql() -> dict:
    """name -> SQL that DuckDB runs over the same tables."""
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}

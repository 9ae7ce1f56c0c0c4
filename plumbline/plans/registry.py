"""All registered queries outside the optional subpackage, gathered by module."""

from __future__ import annotations

from collections.abc import Callable

from plumbline.plans import evidence, ledger, retrieval, statistics, texts

MODULES = [statistics, texts, retrieval, evidence, ledger]


def queries() -> dict[str, Callable]:
    """Name -> (spark, sf_dir) -> DataFrame."""
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL over the same tables."""
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}

"""Queries over the driver's tables, with their SQL."""

from __future__ import annotations

from . import bits, ensembles, files, jobs, matrix, models, traces

_MODULES = [matrix, bits, models, ensembles, files, jobs, traces]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}

"""Queries: operators applied to the driver's tables."""

from __future__ import annotations

from . import activity, audits, calls, incremental, models, outcomes, registry, reports, resolutions, snapshots, tasks, texts

_MODULES = (activity, reports, resolutions, models, audits, texts, snapshots, incremental, tasks, calls, registry, outcomes)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

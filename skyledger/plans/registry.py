"""All registered queries and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

import importlib

_MODULES = [
    "skyledger.plans.merge_queries",
    "skyledger.plans.view_queries",
    "skyledger.plans.unify_queries",
    "skyledger.plans.run_queries",
    "skyledger.plans.normalize_queries",
    "skyledger.plans.io_queries",
    "skyledger.plans.stream_queries",
    "skyledger.plans.quality_queries",
]


def queries() -> dict:
    out = {}
    for m in _MODULES:
        out.update(importlib.import_module(m).QUERIES)
    return out


def oracle_sql() -> dict:
    out = {}
    for m in _MODULES:
        out.update(importlib.import_module(m).SQL)
    return out

"""Registered queries: an operator over the bound tables, and the same in SQL for the oracle."""

from __future__ import annotations

import importlib

from audira.plans.registry import REGISTRY, Query

MODULES = ["kpi_queries", "compare_queries", "person_queries", "video_queries", "prelaunch_queries", "scalar_queries", "storage_queries"]


def all_queries() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"audira.plans.{name}")
    return REGISTRY

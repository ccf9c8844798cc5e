"""All registered queries."""

from __future__ import annotations

from importlib import import_module

_FAMILIES = ["scan_plans", "alert_plans", "health_plans", "request_plans", "secret_plans", "source_plans", "stream_plans"]


def all_plans() -> dict:
    """Name to (query, oracle SQL or None), over all families."""
    plans: dict = {}
    for family in _FAMILIES:
        plans.update(import_module(f"emberwatch.plans.{family}").QUERIES)
    return plans
